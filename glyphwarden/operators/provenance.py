"""Content credentials: what a manifest says, and how far it can be trusted.

Reading a manifest out of a file needs a library that is not here; what follows from the
manifest (JSON) and its validation needs none.  Integrity and trust are two columns: a signature that checks
out says nothing about who signed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# IPTC source types that mean a generative model, and validation states.
AI_SOURCES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia")
INTEGRITY = {"Trusted": "intact", "Valid": "intact", "Invalid": "broken"}
TRUST = {"Trusted": "recognised", "Valid": "unrecognised", "Invalid": "unknown"}
ACTIONS = "c2pa.actions"
MANIFEST = """active_manifest string, manifests map<string, struct<title:string, claim_generator_info:array<struct<name:string>>, signature_info:struct<common_name:string,issuer:string,alg:string>,
    assertions:array<struct<label:string,data:struct<actions:array<struct<action:string,digitalSourceType:string>>>>>>>"""
RESULTS = "activeManifest struct<failure:array<struct<code:string>>>"


def _of(table: dict[str, str], state: Column) -> Column:
    out = F.lit("unknown")
    for k, v in table.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def actions_of(manifest: Column) -> Column:
    """array<struct<action,digitalSourceType>> of all action assertions, in order."""
    mine = F.filter(F.coalesce(manifest["assertions"], F.array().cast("array<struct<label:string,data:struct<actions:array<struct<action:string,digitalSourceType:string>>>>>")), lambda a: F.startswith(a["label"], F.lit(ACTIONS)))
    return F.flatten(F.filter(F.transform(mine, lambda a: a["data"]["actions"]), lambda x: x.isNotNull()))


def ai_declared(actions: Column) -> Column:
    """True when an action names a generative source, false when all that name one name another, null when none does."""
    tails = F.transform(F.filter(actions, lambda a: F.coalesce(a["digitalSourceType"], F.lit("")) != ""), lambda a: F.element_at(F.split(a["digitalSourceType"], "/"), -1))
    return let(tails, lambda t: F.when(F.size(t) > 0, F.exists(t, lambda x: x.isin(*AI_SOURCES))))


def inspect(files: DataFrame, manifest: str = "manifest", state: str = "state", results: str = "results") -> DataFrame:
    """files with present, integrity, trust, raw_state, generator, signer, issuer, algorithm, title, ai_declared, actions, failures, notes, reason.

    A null manifest is a file without one; one that is no JSON is unreadable.  Neither is evidence of tampering.
    """
    df = files.withColumn("__m", F.from_json(manifest, MANIFEST)).withColumn("__a", F.element_at("__m.manifests", F.col("__m.active_manifest"))).withColumn("__x", actions_of(F.col("__a")))
    there = F.coalesce(F.col("__m.manifests").isNotNull(), F.lit(False))
    trust, integrity = _of(TRUST, F.col(state)), _of(INTEGRITY, F.col(state))
    declared = ai_declared(F.col("__x"))
    failures = F.transform(F.from_json(results, RESULTS)["activeManifest"]["failure"], lambda f: F.coalesce(f["code"], F.lit("")))
    notes = F.filter(F.array(
        F.when(trust == "unrecognised", "the signature checks out, but its signer is not on a list of trusted ones: the origin is unverified"),
        F.when(integrity == "broken", "the file does not match what was signed"),
        F.when(declared, "the credential itself declares a generative model"),
    ), lambda n: n.isNotNull())
    given = {
        "integrity": integrity, "trust": trust, "raw_state": F.col(state), "generator": F.get("__a.claim_generator_info", F.lit(0))["name"], "signer": F.col("__a.signature_info.common_name"), "issuer": F.col("__a.signature_info.issuer"),
        "algorithm": F.col("__a.signature_info.alg"), "title": F.col("__a.title"), "ai_declared": declared, "actions": F.filter(F.transform("__x", lambda a: a["action"]), lambda a: F.coalesce(a, F.lit("")) != ""),
        "failures": F.coalesce(failures, F.array().cast("array<string>")), "notes": notes,
    }
    absent = {"integrity": F.lit("unknown"), "trust": F.lit("unknown"), "actions": F.array().cast("array<string>"), "failures": F.array().cast("array<string>"), "notes": F.array().cast("array<string>")}
    out = df.withColumns({"present": there, **{k: F.when(there, v).otherwise(absent.get(k)) if k in absent else F.when(there, v) for k, v in given.items()}})
    return out.withColumn("reason", F.when(F.col(manifest).isNull(), "no content credential in this file").when(~there, "the manifest can't be read")).drop("__m", "__a", "__x", manifest, results, state)


def trust_anchors(pem: Column) -> Column:
    """How many certificates a trust list holds."""
    return F.regexp_count(pem, F.lit("BEGIN CERTIFICATE"))
