"""DuckDB SQL for the queries that SQL can express, written on its own from the semantics."""

from __future__ import annotations

from .functions import lexicons as lex
from .functions import spans
from .operators import style

_WORD = "[\\p{L}\\p{Nl}\\p{No}]+(?:[''’-][\\p{L}\\p{Nl}\\p{No}]+)*"
_TOK = f"list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w))"
_HOUR, _START = 3_600_000, 1_700_000_000_000

_CARRIED = """carried AS (SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN text || array_to_string(list_transform(string_split('WF-' || doc_id, ''), lambda c: chr(unicode(c) + 917504)), '')
  WHEN 1 THEN text || array_to_string(list_transform(string_split('id:' || doc_id, ''), lambda c: chr(unicode(c) - 16 + 917760)), '')
  WHEN 2 THEN text || translate(array_to_string(list_transform(string_split('key ' || doc_id || 'x', ''), lambda c: lpad(bin(unicode(c)), 8, '0')), ''), '01', chr(8203) || chr(8204))
  WHEN 3 THEN replace(text, '. ', '.' || chr(8203) || ' ')
  WHEN 4 THEN translate(text, 'eoa', chr(1077) || chr(1086) || chr(1072))
  WHEN 5 THEN chr(8238) || text || chr(8236)
  WHEN 6 THEN replace(text, ', ', ',' || chr(160) || ' ')
  ELSE text END AS text FROM documents)"""
#: Suspicious characters that the carriers can be.
_HITS = f"""{_CARRIED},
ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS o FROM carried WHERE text <> ''),
hits AS (SELECT doc_id, CAST(o AS INTEGER) AS "offset", CAST(unicode(c) AS INTEGER) AS codepoint, CASE
    WHEN unicode(c) IN (8203, 8204) THEN 'zero_width' WHEN unicode(c) IN (8238, 8236) THEN 'bidi_control' WHEN unicode(c) = 160 THEN 'exotic_space'
    WHEN unicode(c) = 173 THEN 'format_control' WHEN unicode(c) BETWEEN 917760 AND 917999 THEN 'variation_selector' WHEN unicode(c) BETWEEN 917504 AND 917631 THEN 'tag_char' END AS category,
  CASE unicode(c) WHEN 8203 THEN 'ZERO WIDTH SPACE' WHEN 8204 THEN 'ZERO WIDTH NON-JOINER' WHEN 8238 THEN 'RIGHT-TO-LEFT OVERRIDE' WHEN 8236 THEN 'POP DIRECTIONAL FORMATTING'
    WHEN 160 THEN 'NO-BREAK SPACE' WHEN 173 THEN 'SOFT HYPHEN' ELSE CASE WHEN unicode(c) >= 917760 THEN 'VARIATION SELECTOR-' || (unicode(c) - 917760 + 17) ELSE 'TAG CHARACTER U+' || upper(hex(unicode(c))) END END AS name
  FROM ch WHERE unicode(c) IN (160, 173, 8203, 8204, 8236, 8238) OR unicode(c) BETWEEN 917504 AND 917999)"""
_GLYPHS = """g AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda p: p) AS ps FROM carried),
w AS (SELECT doc_id, unnest(ps) AS word, unnest(list_transform(range(len(ps)), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0))) AS pos FROM g),
lw AS (SELECT doc_id, word, pos FROM w WHERE regexp_matches(word, '[еоа]') AND regexp_matches(word, '[A-Za-zÀ-ÖØ-öø-ɏ]') AND length(word) >= 2),
homo AS (SELECT doc_id, word, pos, unnest(string_split(word, '')) AS ch, generate_subscripts(string_split(word, ''), 1) - 1 AS k FROM lw)"""

_ANALYSES = f"""a AS (SELECT 'a' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, 'w' || (doc_id % 7) AS workspace_id,
  CASE doc_id % 10 WHEN 6 THEN 'pending' WHEN 7 THEN 'running' WHEN 8 THEN 'error' ELSE 'done' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'quick' ELSE 'forensic' END AS mode,
  sha256(text) AS text_sha256, CAST(doc_id % 5 AS INTEGER) AS attempts, CASE WHEN doc_id % 10 = 8 THEN 'engine error ' || doc_id END AS error, {_START} + doc_id * {_HOUR} AS created_at,
  CASE WHEN doc_id % 10 <> 6 THEN {_START} + doc_id * {_HOUR} + 1000 END AS started_at, CASE WHEN doc_id % 10 NOT IN (6, 7) THEN {_START} + doc_id * {_HOUR} + 5000 END AS completed_at FROM documents),
m AS (SELECT 'a' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS analysis_id, CAST((doc_id * 37) % 1000 AS DOUBLE) / 1000.0 AS risk_score,
  CASE doc_id % 4 WHEN 0 THEN 'payload_recovered' WHEN 1 THEN 'watermark_suspected' ELSE 'clean' END AS watermark_label, CAST(doc_id % 4 = 0 AS INTEGER) AS payload_count,
  {_START} + doc_id * {_HOUR} + 5000 AS created_at FROM documents WHERE doc_id % 10 NOT IN (6, 7, 8)),
ev AS (SELECT event_id AS id, 'a' || lpad(CAST(event_id % 500 AS VARCHAR), 10, '0') AS analysis_id, event_type AS type, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS created_at FROM events)"""
_SEGS = """seg AS (SELECT doc_id, length(text) AS n, CAST(unnest(range(0, greatest((length(text) - 1) // 300, 0) + 1)) AS INTEGER) AS idx FROM documents),
s AS (SELECT doc_id, n, idx, idx * 300 AS start_offset, least(idx * 300 + 400, n) AS end_offset, CAST((doc_id * 7 + idx * 13) % 100 AS DOUBLE) / 100.0 AS llm_likelihood, idx % 60 AS word_count FROM seg)"""
_NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, text_sha256, mode ORDER BY created_at DESC, id DESC) AS k FROM a WHERE status = 'done') WHERE k = 1)"""
_TOKENS = f"t AS (SELECT doc_id, {_TOK} AS tok FROM documents)"
_COUNTS = f"{_TOKENS}, c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(tok) AS token FROM t) GROUP BY ALL)"
_GRAMS = f"{_TOKENS}, p AS (SELECT doc_id, tok, unnest(range(1, len(tok) - 3)) AS i FROM t WHERE len(tok) >= 5), g AS (SELECT doc_id, array_to_string(tok[i:i + 4], ' ') AS gram, count(*) AS n, min(i) AS first_pos FROM p GROUP BY ALL HAVING count(*) > 1)"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _steps(n: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {a} THEN {v}" for a, v in sorted(steps, reverse=True)) + " ELSE 0 END"


def _severity(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85 THEN 'critical' WHEN {x} >= 0.65 THEN 'high' WHEN {x} >= 0.4 THEN 'medium' WHEN {x} >= 0.15 THEN 'low' ELSE 'info' END"


def _payload(kind: int, prefix: str, suffix: str, per_byte: int) -> str:
    said = f"('{prefix}' || doc_id || '{suffix}')"
    return f"SELECT doc_id, {said} AS payload, CAST(length({said}) AS INTEGER) AS byte_length, CAST({per_byte} * length({said}) AS INTEGER) AS n_carriers FROM documents WHERE doc_id % 8 = {kind}"


def _payload_all(kind: int, prefix: str, suffix: str, per_byte: int) -> str:
    return f"SELECT doc_id, payload, byte_length, n_carriers FROM documents LEFT JOIN ({_payload(kind, prefix, suffix, per_byte)}) USING (doc_id)"


_STRIPPED = "regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{E0000}-\\x{E007F}\\x{E0100}-\\x{E01EF}]', '', 'g')"
_GAPS = f"""WITH {_HITS}, gap AS (SELECT doc_id, "offset" - lag("offset") OVER (PARTITION BY doc_id ORDER BY "offset") AS g FROM hits)"""
_LANG_SCORE = {
    code: f"round((len(list_filter(h, lambda w: w IN {_in(stops)})) / len(h))" + (f" + least(0.15, len(regexp_extract_all(low, '[{lex.HINTS[code]}]')) / greatest(length(low), 1) * 6.0)" if code in lex.HINTS else "") + ", 4)"
    for code, stops in lex.STOPWORDS.items()
}
_LANG = f"""WITH t0 AS (SELECT doc_id, lang, lower(text) AS low, ({_TOK})[1:2000] AS h FROM documents), sc AS (SELECT doc_id, lang, unnest([{", ".join(f"{{'code': '{c}', 'rank': {i}, 'score': {s}}}" for i, (c, s) in enumerate(_LANG_SCORE.items()))}]) AS x FROM t0 WHERE len(h) > 0),
o AS (SELECT doc_id, lang, x.code AS code, x.score AS score, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.rank) AS k FROM sc),
f AS (SELECT doc_id, lang, max(CASE WHEN k = 1 THEN code END) AS code, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2 FROM o GROUP BY ALL),
l AS (SELECT d.doc_id, d.lang, CASE WHEN s1 >= 0.08 THEN code ELSE 'unknown' END AS language,
  coalesce(CASE WHEN s1 >= 0.08 THEN round(least(1.0, 0.5 + (s1 - s2) * 6), 3) ELSE round(s1 * 4, 3) END, 0.0) AS language_confidence FROM documents d LEFT JOIN f USING (doc_id))"""

# -- measures, style and signals of texts, from a CTE named by the caller with (doc_id, text) --------------------------------------------------

_CLEAN = f"clean AS (SELECT doc_id, {_STRIPPED.replace('text', "nfc_normalize(replace(regexp_replace(text, '" + chr(92) + "r" + chr(92) + "n?', chr(10), 'g'), chr(160), ' '))", 1)} AS text FROM src)"
_ABBREVIATED = "(?i)((?:^|[\\s(])(?:" + "|".join(sorted(a.replace(".", "\\.") for a in spans.ABBREVIATIONS)) + "))[.][.!?…]*[\"''”’)\\]]*(\\s)"
_KEPT = f"regexp_replace(regexp_replace(text, '{_ABBREVIATED}', '\\1' || chr(57344) || '\\2', 'g'), '{_ABBREVIATED}', '\\1' || chr(57344) || '\\2', 'g')"
_PIECES = f"list_filter(string_split(regexp_replace({_KEPT}, '([.!?…]+[\"''”’)\\]]*)\\s+|\\n{{2,}}', '\\1' || chr(30), 'g'), chr(30)), lambda s: regexp_matches(s, '\\S'))"
_N_WORDS = f"lambda s: len(regexp_extract_all(s, '{_WORD}'))"


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {_quoted(part)}, ''))) / {len(part)})"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rate(table: dict) -> str:
    def hits(words) -> str:
        return " + ".join([f"len(list_filter(tok, lambda w: w IN {_in(w for w in words if ' ' not in w)}))" if any(" " not in w for w in words) else "0", *(_count("low", w) for w in words if " " in w)])

    return f"(CASE WHEN language = 'pl' THEN {hits(table['pl'])} ELSE {hits(table['en'])} END) * 100.0 / greatest(n_words, 1)"


_SPREAD = "coalesce((SELECT CASE WHEN count(v) >= 2 THEN stddev_pop(v) / avg(v) END FROM (SELECT unnest({0}) AS v) WHERE v > 0), 0)"
_EACH = f"regexp_extract_all(text, '{_WORD}')"
_SPACED = "regexp_replace(text, '(\\s)', '\\1\\1', 'g')"
_MEASURES = {
    "mean_sentence_length": "CASE WHEN n_sentences > 0 THEN coalesce(list_sum(sl), 0) / n_sentences ELSE 0 END",
    "sentence_length_cv": _SPREAD.format("sl"), "paragraph_length_cv": _SPREAD.format("pl"),
    "mean_word_length": "CASE WHEN n_words > 0 THEN list_sum(list_transform(tok, lambda w: length(w))) / n_words ELSE 0 END",
    "long_word_ratio": "CASE WHEN n_words > 0 THEN len(list_filter(tok, lambda w: length(w) >= 7)) / n_words ELSE 0 END",
    "mattr": "CAST(round(CAST(printf('%.18f', CAST(CASE WHEN n_words = 0 THEN 0.0 WHEN n_words <= 50 THEN len(list_distinct(tok)) / n_words ELSE list_avg(list_transform(range(1, n_words - 48, 10), lambda i: len(list_distinct(tok[i:i + 49])))) / 50 END AS DOUBLE)) AS DECIMAL(38, 20)), 6) AS DOUBLE)",
    "hapax_ratio": "CASE WHEN n_words > 0 THEN (SELECT sum(CAST(n = 1 AS INTEGER)) / count(*) FROM (SELECT count(*) AS n FROM (SELECT unnest(tok) AS w) GROUP BY w)) ELSE 0 END",
    "discourse_marker_rate": _rate(lex.DISCOURSE), "assistant_lexicon_rate": _rate(lex.ASSISTANT), "hedge_rate": _rate(lex.HEDGES),
    "contraction_rate": f"CASE WHEN language = 'en' THEN len(list_filter(tok, lambda w: w IN {_in(lex.CONTRACTIONS)})) * 100.0 / greatest(n_words, 1) ELSE 0 END",
    "personal_pronoun_rate": _rate(lex.FIRST_PERSON), "em_dash_rate": f"{_count('text', '—')} * 1000.0 / greatest(n_chars, 1)",
    "curly_quote_ratio": "CASE WHEN regexp_matches(text, '[‘’“”„«»\"'']') THEN len(regexp_extract_all(text, '[‘’“”„«»]')) / len(regexp_extract_all(text, '[‘’“”„«»\"'']')) ELSE 0 END",
    "ellipsis_char_rate": f"{_count('text', '…')} * 1000.0 / greatest(n_chars, 1)",
    "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN len(regexp_extract_all(text, '(?m)^\\s*(?:[-*•‣·]|\\d+[.)]|[a-z][.)])\\s+')) / n_lines ELSE 0 END",
    "sentence_start_repetition": "CASE WHEN n_sentences > 0 THEN (len(openings) - len(list_distinct(openings))) / n_sentences ELSE 0 END",
    "typo_indicator_rate": f"""(len(regexp_extract_all(text, '[^\\s] {{2,}}')) - len(regexp_extract_all(text, '[^\\s] {{2,}}(?:[\\s]|$)')) + len(regexp_extract_all({_SPACED}, '\\s+[,;:!?](?:\\s|$)'))
      + len(regexp_extract_all(text, '[!?]{{2,}}|\\.{{4,}}|,{{2,}}')) + len(regexp_extract_all(low, '[a-ząćęłńóśźż],[a-ząćęłńóśźż]'))) * 1000.0 / greatest(n_chars, 1)""",
    "comma_per_sentence": f"CASE WHEN n_sentences > 0 THEN {_count('text', ',')} / n_sentences ELSE 0 END", "exclamation_rate": f"{_count('text', '!')} * 1000.0 / greatest(n_chars, 1)",
}
_LANGUAGE = f"""t0 AS (SELECT doc_id, lower(text) AS low, list_transform({_EACH}, lambda w: lower(w))[1:2000] AS h FROM clean), sc AS (SELECT doc_id, unnest([{", ".join(f"{{'code': '{c}', 'rank': {i}, 'score': {s}}}" for i, (c, s) in enumerate(_LANG_SCORE.items()))}]) AS x FROM t0 WHERE len(h) > 0),
o AS (SELECT doc_id, x.code AS code, x.score AS score, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.rank) AS k FROM sc), l AS (SELECT doc_id, CASE WHEN score >= 0.08 THEN code ELSE 'unknown' END AS language FROM o WHERE k = 1)"""
_STUDIED = f"""{_CLEAN}, {_LANGUAGE},
b AS (SELECT doc_id, text, lower(text) AS low, list_transform({_EACH}, lambda w: lower(w)) AS tok, {_PIECES} AS ss, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda s: regexp_matches(s, '\\S')) AS ps,
  len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\x0C\\r\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_matches(s, '[^\\s\\x{{A0}}]'))) AS n_lines FROM clean),
d AS (SELECT b.doc_id, text, low, tok, n_lines, coalesce(language, 'unknown') AS language, CAST(len(tok) AS INTEGER) AS n_words, CAST(len(ss) AS INTEGER) AS n_sentences, CAST(len(ps) AS INTEGER) AS n_paragraphs, CAST(length(text) AS INTEGER) AS n_chars,
  list_transform(ss, {_N_WORDS}) AS sl, list_transform(ps, {_N_WORDS}) AS pl, list_filter(list_transform(ss, lambda s: trim(lower(regexp_extract(s, '\\S+')), '.,;:—-' || chr(57344))), lambda w: w <> '') AS openings FROM b LEFT JOIN l USING (doc_id)),
ms AS (SELECT doc_id, text, n_lines, language, n_words, n_sentences, n_paragraphs, n_chars, {", ".join(f"round_even(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _MEASURES.items())} FROM d)"""


def _part(name: str) -> str:
    mean, sd, weight = style.PRIOR[name]
    part = f"greatest(-{style.CLIP}, least({style.CLIP}, ({name} - {mean}) / {sd})) * ({weight} * {style.TEMPERATURE})"
    return f"CASE WHEN language = 'en' THEN {part} ELSE 0 END" if name == "contraction_rate" else part


_STYLED = f"""st AS (SELECT *, greatest(0.02, least(0.98, 0.5 + (1 / (1 + exp(-({style.BIAS} + {" + ".join(f"({_part(n)})" for n in style.PRIOR)}))) - 0.5) * least(1.0, sqrt(n_words / {style.FULL_WORDS})))) AS v,
  greatest(0.05, least(0.35, 0.5 / sqrt(greatest(n_words, 1) / 60.0))) AS half FROM ms),
sj AS (SELECT *, round(v, 4) AS style_value, round(greatest(0.0, v - half), 4) AS style_low, round(least(1.0, v + half), 4) AS style_high,
  CASE WHEN n_words < 15 THEN 'insufficient_text' WHEN v >= 0.85 THEN 'likely_assistant_strong' WHEN v >= 0.65 THEN 'likely_assistant' WHEN v <= 0.35 THEN 'likely_human' ELSE 'inconclusive' END AS style_label,
  CASE WHEN n_words < 15 THEN 'none' WHEN half <= 0.12 AND n_words >= 250 THEN 'high' WHEN half <= 0.22 THEN 'medium' ELSE 'low' END AS style_confidence FROM st)"""
_PLAIN_DOCS = "src AS (SELECT doc_id, text FROM documents)"


def _trait(name: str, target: float, tolerance: float, way: str, weight: float, language: str | None) -> tuple[str, str]:
    away = {"at_least": f"greatest(0.0, {target} - {name})", "at_most": f"greatest(0.0, {name} - {target})"}[way]
    pen = f"least(1.0, {away} / {tolerance}) * {weight}"
    return (f"CASE WHEN language = '{language}' THEN {pen} ELSE 0 END", f"CASE WHEN language = '{language}' THEN {weight} ELSE 0 END") if language else (pen, str(weight))


_ALIKE = ", ".join(
    "{'family': '" + family + f"', 'rank': {i}, 'similarity': round(least({style.MOST_ALIKE}, greatest(0.0, 1 - ({' + '.join(f'({_trait(*t)[0]})' for t in traits)}) / ({' + '.join(f'({_trait(*t)[1]})' for t in traits)}))), 4)}}"
    for i, (family, traits) in enumerate(style.PROFILES.items())
)
_OPENINGS = "certainly|sure|of course|great question|absolutely|happy to help|oczywiście|jasne|świetne pytanie|z przyjemnością"

# -- every signal of the carried documents, and what follows from them -------------------------------------------------------------------------

_SOFT = f"""nrm AS (SELECT doc_id, nfc_normalize(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' ')) AS text FROM carried),
nx AS (SELECT doc_id, text, list_transform({_EACH}, lambda w: lower(w)) AS tok, list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\x0C\\r\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_matches(s, '\\S')) AS lines,
  len(regexp_extract_all(text, '[—…‑]')) AS dashes, len(regexp_extract_all(text, '[‘’“”]')) AS curly, len(regexp_extract_all(text, '["'']')) AS straight FROM nrm),
ng AS (SELECT doc_id, sum(n) AS again FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, array_to_string(tok[i:i + 4], ' ') AS g FROM (SELECT doc_id, tok, unnest(range(1, len(tok) - 3)) AS i FROM nx WHERE len(tok) >= 40)) GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
soft AS (SELECT doc_id, 'typographic_fingerprint' AS id, least(0.75, dashes * 1000.0 / greatest(length(text), 1) / 6.0 + CASE WHEN curly + straight > 0 THEN curly / (curly + straight) * 0.35 ELSE 0 END) AS score, 0.35 AS weight FROM nx WHERE score >= 0.12
  UNION ALL SELECT doc_id, 'ngram_recycling', least(0.7, again * 5.0 / (len(tok) - 4)) AS s, 0.3 FROM ng JOIN nx USING (doc_id) WHERE s >= 0.12
  UNION ALL SELECT doc_id, 'structural_uniformity', least(0.6, (len(list_filter(lines, lambda s: regexp_matches(s, '^\\s*(?:[-*•]|\\d+[.)])\\s+'))) + len(regexp_extract_all(text, '(?m)^\\s*(#{{1,6}}\\s+\\S|\\*\\*[^*\\n]+\\*\\*\\s*$)'))) / len(lines) * 0.9
    + least((length(text) - length(replace(text, '**', ''))) / 2 // 2, 12) * 0.02) AS s, 0.25 FROM nx WHERE len(lines) >= 6 AND s >= 0.15)"""
_HARD = f""", r AS (SELECT doc_id, CASE WHEN count(*) >= 4 AND avg(g) > 0 THEN greatest(0.0, least(1.0, 1 - stddev_pop(g) / avg(g))) ELSE 0.0 END AS reg, count(*) AS n, min(category) AS cat FROM gap JOIN (SELECT doc_id, min(category) AS category FROM hits GROUP BY doc_id) USING (doc_id) GROUP BY doc_id),
  {_GLYPHS}, hg AS (SELECT doc_id, count(*) AS n FROM homo WHERE ch IN ('е', 'о', 'а') GROUP BY doc_id),
  u AS (SELECT doc_id, 'payload_' || CASE doc_id % 8 WHEN 0 THEN 'tag_characters' WHEN 1 THEN 'variation_selectors' ELSE 'zero_width_binary' END AS id, 0.97 AS score, 1.0 AS weight FROM documents WHERE doc_id % 8 < 3
    UNION ALL SELECT doc_id, 'invisible_characters', least(0.99, {_steps('n', ((1, 0.45), (2, 0.6), (5, 0.75), (20, 0.88), (64, 0.94)))} + 0.08 * reg), 1.0 FROM r WHERE cat IN ('zero_width', 'tag_char', 'variation_selector')
    UNION ALL SELECT doc_id, 'bidi_controls', {_steps('n', ((1, 0.55), (2, 0.7), (6, 0.85)))}, 0.9 FROM r WHERE cat = 'bidi_control'
    UNION ALL SELECT doc_id, 'exotic_whitespace', least(0.8, {_steps('n', ((1, 0.12), (4, 0.25), (15, 0.4), (50, 0.55)))} + 0.25 * reg), 0.5 FROM r WHERE cat = 'exotic_space'
    UNION ALL SELECT doc_id, 'homoglyph_substitution', {_steps('n', ((1, 0.5), (3, 0.68), (10, 0.85), (30, 0.93)))}, 0.95 FROM hg)"""
_EVERY = _GAPS + _HARD + ", " + _SOFT
_MARKED = """hs AS (SELECT doc_id, list_reverse_sort(list(CAST(score AS DOUBLE) * CAST(weight AS DOUBLE))) AS p, bool_or(id LIKE 'payload%') AS payload FROM u GROUP BY doc_id),
sf AS (SELECT doc_id, sum(CAST(score AS DOUBLE) * weight) / sum(weight) AS s FROM soft GROUP BY doc_id),
wm0 AS (SELECT c.doc_id, coalesce(payload, false) AS payload, p IS NOT NULL AS hard, s IS NOT NULL AS is_soft, least(0.99, greatest(coalesce(list_reduce(p, lambda a, x: a + (1 - a) * x * 0.5), 0.0), coalesce(s, 0.0) * 0.45)) AS w FROM carried c LEFT JOIN hs USING (doc_id) LEFT JOIN sf USING (doc_id)),
wm1 AS (SELECT *, CASE WHEN payload THEN greatest(w, 0.95) ELSE w END AS x FROM wm0),
wm AS (SELECT doc_id, CAST(round(CAST(printf('%.18f', x) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS watermark_score, CASE WHEN payload THEN 'payload_recovered' WHEN x >= 0.8 THEN 'watermark_detected' WHEN x >= 0.5 THEN 'watermark_suspected' WHEN x >= 0.2 THEN 'weak_indicators' ELSE 'clean' END AS watermark_label,
  CASE WHEN payload OR x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS watermark_confidence, CASE WHEN hard THEN 'bytes' WHEN is_soft THEN 'stylistic' ELSE 'none' END AS watermark_basis FROM wm1)"""
_RISKY = f"""{_EVERY}, {_MARKED}, src AS (SELECT doc_id, text FROM carried), {_STUDIED}, {_STYLED},
  nf AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, id, score FROM u UNION ALL SELECT doc_id, id, score FROM soft) WHERE id LIKE 'payload%' OR score >= 0.4 GROUP BY doc_id),
  rk AS (SELECT sj.*, watermark_label, watermark_score, coalesce(nf.n, 0) + CAST(style_label <> 'inconclusive' AS INTEGER) AS n_findings, CASE WHEN style_label = 'insufficient_text' THEN 0.85 * watermark_score ELSE 0.75 * watermark_score + 0.25 * greatest(0.0, v - 0.5) * 2 END AS base FROM sj JOIN wm USING (doc_id) LEFT JOIN nf USING (doc_id)),
  an AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN watermark_label = 'payload_recovered' THEN greatest(base, 0.9) ELSE base END)), 4) AS risk_score FROM rk)"""
_RISK_LABEL = "CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.35 THEN 'medium' WHEN risk_score >= 0.15 THEN 'low' ELSE 'minimal' END"

ORACLE_SQL = {
    "payload_tag_decode": _payload(0, "WF-", "", 1), "payload_vs_decode": _payload(1, "id:", "", 1), "payload_zwb_decode": _payload(2, "key ", "x", 8),
    "payload_tag_decode_all": _payload_all(0, "WF-", "", 1), "payload_vs_decode_all": _payload_all(1, "id:", "", 1), "payload_zwb_decode_all": _payload_all(2, "key ", "x", 8),
    "trace_leak_all": "SELECT doc_id, payload, recipient FROM documents, (VALUES ('ann#1', 'ann'), ('bob#2', 'bob'), ('cho#3', 'cho')) r(payload, recipient)",
    "invisible_char_scan": f"""WITH {_HITS} SELECT doc_id, "offset", codepoint, category, name FROM hits""",
    "char_context": f"""WITH {_HITS} SELECT h.doc_id, "offset", replace({_STRIPPED.replace('text', "(substr(c.text, greatest(" + '"offset"' + " - 24, 0) + 1, " + '"offset"' + " - greatest(" + '"offset"' + " - 24, 0)) || '‸' || substr(c.text, " + '"offset"' + " + 2, 24))", 1)}, chr(10), ' ') AS context FROM hits h JOIN carried c USING (doc_id) WHERE category = 'zero_width'""",
    "invisible_by_name": f"""WITH {_HITS}, e AS (SELECT doc_id, 'U+' || CASE WHEN length(hex(codepoint)) < 4 THEN lpad(hex(codepoint), 4, '0') ELSE hex(codepoint) END || ' ' || name AS label, count(*) AS n FROM hits GROUP BY ALL)
      SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hits, string_agg(label || ' x' || n, ', ' ORDER BY label) AS summary FROM e GROUP BY doc_id""",
    "hit_gap_regularity": _GAPS + """, st AS (SELECT doc_id, count(*) AS n_hits, avg(g) AS mean, stddev_pop(g) AS sd FROM gap GROUP BY doc_id)
      SELECT doc_id, n_hits, round(mean, 6) AS mean_gap, round(CASE WHEN n_hits >= 4 AND mean > 0 THEN greatest(0.0, least(1.0, 1 - sd / mean)) ELSE 0.0 END, 6) AS regularity FROM st""",
    "homoglyph_hits": f"""WITH {_CARRIED}, {_GLYPHS} SELECT doc_id, CAST(pos + k AS INTEGER) AS "offset", ch, translate(ch, 'еоа', 'eoa') AS latin, 'CYRILLIC' AS script, word FROM homo WHERE ch IN ('е', 'о', 'а')""",
    "homoglyph_words": f"""WITH {_CARRIED}, {_GLYPHS}, h AS (SELECT doc_id, word FROM homo WHERE ch IN ('е', 'о', 'а')) SELECT doc_id, count(*) AS n_hits, array_to_string(list_sort(list_distinct(list(word)))[1:12], ', ') AS words FROM h GROUP BY doc_id""",
    "script_profile": f"""WITH {_CARRIED}, l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}')) AS c FROM carried) SELECT doc_id, CASE WHEN unicode(c) BETWEEN 1024 AND 1327 THEN 'CYRILLIC' WHEN unicode(c) < 592 AND unicode(c) NOT IN (170, 181, 186) THEN 'LATIN' ELSE 'OTHER' END AS script, count(*) AS n FROM l GROUP BY ALL""",
    "strip_invisible": f"WITH {_CARRIED}, x AS (SELECT doc_id, {_STRIPPED} AS t FROM carried) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM x",
    "normalize_whitespace": f"WITH {_CARRIED} SELECT doc_id, sha256(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' ')) AS sha256 FROM carried",
    "nfc_clean": f"WITH {_CARRIED}, x AS (SELECT doc_id, nfc_normalize(replace(regexp_replace(replace(text, 'é', 'e' || chr(769)), '\\r\\n?', chr(10), 'g'), chr(160), ' ')) AS text FROM carried) SELECT doc_id, sha256({_STRIPPED}) AS sha256 FROM x",
    "sanitize_safe": f"WITH {_CARRIED}, x AS (SELECT doc_id, {_STRIPPED} AS t FROM carried) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM x",
    "sanitize_aggressive": f"WITH {_CARRIED}, x AS (SELECT doc_id, replace({_STRIPPED}, chr(160), ' ') AS t FROM carried) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM x",
    "sanitize_audit": f"""WITH {_HITS} SELECT doc_id, CASE WHEN codepoint = 160 THEN 'preserved' ELSE 'removed' END AS decision, count(*) AS n, min("offset") AS first_offset FROM hits GROUP BY ALL""",
    "watermark_signals": _EVERY + f""" SELECT doc_id, id, round(CAST(score AS DOUBLE), 6) AS score, CAST(weight AS DOUBLE) AS weight, {_severity('score')} AS severity FROM (SELECT * FROM u UNION ALL SELECT * FROM soft)""",
    "watermark_score": f"{_EVERY}, {_MARKED} SELECT doc_id, watermark_score, watermark_label, watermark_confidence, watermark_basis FROM wm",
    "style_features": f"WITH {_PLAIN_DOCS}, {_STUDIED} SELECT ms.doc_id, language, n_words, n_sentences, n_paragraphs, n_chars, CAST(length(text) AS INTEGER) AS n_chars_source, n_words AS n_words_source, {', '.join(_MEASURES)} FROM ms",
    "style_score": f"WITH {_PLAIN_DOCS}, {_STUDIED}, {_STYLED} SELECT doc_id, style_value, style_low, style_high, style_label, style_confidence FROM sj",
    "style_contributions": f"""WITH {_PLAIN_DOCS}, {_STUDIED}, p AS (SELECT doc_id, unnest([{', '.join("{'i': " + str(i) + f", 'feature': '{n}', 'value': {n}, 'z': greatest(-{style.CLIP}, least({style.CLIP}, ({n} - {style.PRIOR[n][0]}) / {style.PRIOR[n][1]})), 'part': CAST({_part(n)} AS DOUBLE), 'counts': {"language = 'en'" if n == 'contraction_rate' else 'true'}}}" for i, n in enumerate(style.PRIOR))}]) AS c FROM ms)
      SELECT doc_id, CAST(k - 1 AS INTEGER) AS rank, feature, round(value, 4) AS value, round(z, 3) AS z, round(part, 4) AS contribution, CASE WHEN part > 0 THEN 'assistant' ELSE 'human' END AS direction FROM (SELECT doc_id, c.*, row_number() OVER (PARTITION BY doc_id ORDER BY abs(c.part) DESC, c.i) AS k FROM p WHERE c.counts) WHERE k <= 10""",
    "profile_match": f"""WITH {_PLAIN_DOCS}, {_STUDIED}, pr AS (SELECT *, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) / greatest(n_lines, 1) AS bold_run_rate, CAST(regexp_matches(text, '(?i)^\\s*({_OPENINGS})\\b[!,.]') AS DOUBLE) AS opening_pleasantry FROM ms),
      q AS (SELECT doc_id, unnest([{_ALIKE}]) AS p FROM pr) SELECT doc_id, CAST(k - 1 AS INTEGER) AS rank, family, similarity FROM (SELECT doc_id, p.family AS family, p.similarity AS similarity, row_number() OVER (PARTITION BY doc_id ORDER BY p.similarity DESC, p.rank) AS k FROM q) WHERE k <= 3""",
    "analyse": f"{_RISKY} SELECT doc_id, watermark_label, style_label, language, n_words, risk_score, {_RISK_LABEL} AS risk_label, CAST(n_findings AS INTEGER) AS n_findings FROM an",
    "analyse_distinct": f"{_RISKY.replace('src AS (SELECT doc_id, text FROM carried)', _PLAIN_DOCS).replace(_CARRIED, 'carried AS (SELECT doc_id, text FROM documents)').replace('WHERE doc_id % 8 < 3', 'WHERE false')} SELECT doc_id, sha256(d0.text) AS sha256, risk_score, style_label FROM an JOIN documents d0 USING (doc_id)",
    "latinize_homoglyphs": f"""WITH {_CARRIED}, g AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ps FROM carried)
      SELECT doc_id, sha256(array_to_string(list_transform(ps, lambda w: CASE WHEN length(w) >= 2 AND regexp_matches(w, '[A-Za-zÀ-ÖØ-öø-ɏ]') THEN translate(w, 'еоа', 'eoa') ELSE w END), '')) AS sha256 FROM g""",
    "trace_leak": "SELECT doc_id, 'bob#2' AS payload, 'bob' AS recipient FROM documents WHERE doc_id % 3 = 0",
    "language_detect": _LANG + " SELECT doc_id, language, language_confidence FROM l",
    "language_confusion": _LANG + " SELECT lang, language, count(*) AS n FROM l GROUP BY ALL",
    "word_counts": f"WITH {_COUNTS} SELECT doc_id, token, n FROM c",
    "hapax": f"WITH {_COUNTS} SELECT doc_id, count(*) AS types, CAST(sum(CAST(n = 1 AS INTEGER)) AS BIGINT) AS hapax, round(sum(CAST(n = 1 AS INTEGER)) / count(*), 6) AS ratio FROM c GROUP BY doc_id",
    "mattr": f"""WITH {_TOKENS}, x AS (SELECT doc_id, CASE WHEN len(tok) = 0 THEN 0.0 WHEN len(tok) <= 50 THEN len(list_distinct(tok)) / len(tok)
      ELSE list_avg(list_transform(range(1, len(tok) - 48, 10), lambda i: len(list_distinct(tok[i:i + 49])) / 50.0)) END AS v FROM t) SELECT doc_id, round(v, 6) AS mattr FROM x""",
    "ngram_top": f"WITH {_GRAMS} SELECT doc_id, CAST(k AS INTEGER) AS rank, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS k FROM g) WHERE k <= 8",
    "ngram_recycling": f"WITH {_GRAMS} SELECT doc_id, count(*) AS distinct_repeated, CAST(sum(n) AS BIGINT) AS repeated, round(sum(n) / (len(any_value(tok)) - 4), 6) AS rate FROM g JOIN t USING (doc_id) GROUP BY doc_id",
    "lexicon_counts": f"""WITH {_TOKENS} SELECT doc_id, {", ".join(f"CAST(len(list_filter(tok, lambda w: w IN {_in(v)})) AS INTEGER) AS {k}" for k, v in (("pronouns", lex.FIRST_PERSON["en"]), ("stopwords_en", lex.STOPWORDS["en"]), ("stopwords_fr", lex.STOPWORDS["fr"]), ("contractions", lex.CONTRACTIONS)))} FROM t""",
    "typo_counts": """SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s] {2,}')) - len(regexp_extract_all(text, '[^\\s] {2,}(?:[\\s]|$)')) AS INTEGER) AS double_space,
      CAST(len(regexp_extract_all(text, '[!?]{2,}|\\.{4,}|,{2,}')) AS INTEGER) AS repeated, CAST(len(regexp_extract_all(lower(text), '[a-ząćęłńóśźż],[a-ząćęłńóśźż]')) AS INTEGER) AS missing_space FROM documents""",
    "punctuation_counts": """SELECT doc_id, CAST(length(text) - length(replace(text, ',', '')) AS INTEGER) AS commas, CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS exclamations,
      CAST(length(text) - length(replace(text, '—', '')) AS INTEGER) AS em_dashes, CAST(len(regexp_extract_all(text, '["'']')) AS INTEGER) AS straight_quotes, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate FROM documents""",
    "line_counts": """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\x0C\\r\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]'), lambda s: regexp_matches(s, '[^\\s\\x{A0}]'))) AS INTEGER) AS filled_lines,
      CAST(len(regexp_extract_all(text, '(?m)^[ \\t]*(?:[-*•‣·]|\\d+[.)]|[a-z][.)])[ \\t]+')) AS INTEGER) AS bullets FROM documents""",
    "paragraph_spans": """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents)
      SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS idx, unnest(ps) AS paragraph FROM p WHERE len(ps) > 0""",
    "segment_hits": f"""WITH {_HITS}, {_SEGS} SELECT s.doc_id, s.idx, count(h."offset") AS watermark_hits FROM s LEFT JOIN hits h ON h.doc_id = s.doc_id AND h."offset" >= start_offset AND h."offset" < end_offset GROUP BY ALL""",
    "heatmap_fragments": f"""WITH {_SEGS}, c AS (SELECT doc_id, start_offset AS cut FROM s UNION SELECT doc_id, end_offset FROM s UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, length(text) FROM documents),
      p AS (SELECT * FROM (SELECT doc_id, cut AS start, lead(cut) OVER (PARTITION BY doc_id ORDER BY cut) AS stop FROM c) WHERE stop IS NOT NULL)
      SELECT p.doc_id, CAST(p.start AS INTEGER) AS start, CAST(p.stop AS INTEGER) AS "end", round(avg(llm_likelihood), 6) AS score, count(llm_likelihood) AS n_segments FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND start_offset < stop AND end_offset > start GROUP BY ALL""",
    "doc_mean_score": f"WITH {_SEGS} SELECT doc_id, count(*) AS n_segments, round(sum(llm_likelihood * greatest(1, word_count)) / sum(greatest(1, word_count)), 6) AS mean_score FROM s GROUP BY doc_id",
    "carrier_offsets": f"""WITH {_HITS} SELECT DISTINCT doc_id, CAST("offset" + k AS INTEGER) AS at FROM hits, (VALUES (0), (1)) v(k)""",
    "risk_score": f"""WITH {_ANALYSES}, x AS (SELECT analysis_id, watermark_label, risk_score * CAST(0.9871234 AS DOUBLE) AS w, (CAST(round(risk_score * 1000) AS INTEGER) % 97) / 96.0 AS v FROM m),
      y AS (SELECT analysis_id, round(greatest(0.0, least(1.0, CASE WHEN watermark_label = 'payload_recovered' THEN greatest(b, 0.9) ELSE b END)), 4) AS r FROM (SELECT *, CASE WHEN v < 0.1 THEN 0.85 * w ELSE 0.75 * w + 0.25 * greatest(0.0, v - 0.5) * 2 END AS b FROM x))
      SELECT analysis_id, CAST(r AS DOUBLE) AS risk_score, CASE WHEN r >= 0.8 THEN 'critical' WHEN r >= 0.6 THEN 'high' WHEN r >= 0.35 THEN 'medium' WHEN r >= 0.15 THEN 'low' ELSE 'minimal' END AS risk_label FROM y""",
    "list_analyses_page": f"WITH {_ANALYSES} SELECT a.id, status, risk_score, watermark_label, a.created_at FROM a LEFT JOIN m ON analysis_id = a.id WHERE workspace_id = 'w3' ORDER BY a.created_at DESC, a.id DESC LIMIT 20 OFFSET 20",
    "stats_by_status": f"WITH {_ANALYSES} SELECT x.status, count(a.id) AS n FROM (VALUES ('pending'), ('running'), ('done'), ('error')) x(status) LEFT JOIN a ON a.status = x.status AND workspace_id = 'w2' GROUP BY x.status UNION ALL SELECT 'total', count(*) FROM a WHERE workspace_id = 'w2'",
    "stats_headline": f"WITH {_ANALYSES} SELECT count(*) AS n, round(avg(risk_score), 4) AS average_risk, CAST(coalesce(sum(CAST(watermark_label <> 'clean' AS INTEGER)), 0) AS BIGINT) AS watermarks, CAST(coalesce(sum(CAST(payload_count > 0 AS INTEGER)), 0) AS BIGINT) AS payloads FROM m JOIN a ON a.id = analysis_id WHERE workspace_id = 'w1'",
    "stats_daily": f"WITH {_ANALYSES} SELECT strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM a WHERE created_at >= {_START + 150 * _HOUR} - 7 * 86400000 GROUP BY day",
    "dedup_latest": f"WITH {_ANALYSES}, {_NEWEST} SELECT workspace_id, text_sha256, mode, id FROM newest",
    "dedup_reused": f"WITH {_ANALYSES}, {_NEWEST} SELECT a.id, n.id AS reused_id FROM a JOIN newest n ON n.workspace_id = 'w1' AND n.text_sha256 = a.text_sha256 AND n.mode = a.mode WHERE a.status = 'pending'",
    "dedup_to_run": f"WITH {_ANALYSES}, {_NEWEST} SELECT a.id, a.mode FROM a WHERE a.status = 'pending' AND NOT EXISTS (SELECT 1 FROM newest n WHERE n.workspace_id = 'w1' AND n.text_sha256 = a.text_sha256 AND n.mode = a.mode)",
    "stalled_jobs": f"WITH {_ANALYSES} SELECT id, status, attempts, created_at FROM a WHERE attempts < 3 AND ((status = 'pending' AND created_at < {_START + 400 * _HOUR}) OR (status = 'running' AND started_at < {_START + 400 * _HOUR})) ORDER BY created_at, id LIMIT 10",
    "exhausted_jobs": f"WITH {_ANALYSES} SELECT id, status, attempts, created_at FROM a WHERE attempts >= 3 AND status IN ('pending', 'running') ORDER BY created_at, id LIMIT 25",
    "event_trail": f"WITH {_ANALYSES} SELECT analysis_id, id, CAST(row_number() OVER w AS INTEGER) AS step, created_at - lag(created_at) OVER w AS since_ms FROM ev WINDOW w AS (PARTITION BY analysis_id ORDER BY created_at, id)",
    "recent_errors": f"WITH {_ANALYSES} SELECT ev.id, analysis_id, type, error FROM ev LEFT JOIN a ON a.id = analysis_id WHERE status = 'error' ORDER BY ev.created_at DESC, ev.id DESC LIMIT 20",
    "risk_triage_topk": f"WITH {_ANALYSES} SELECT a.id, risk_score FROM a LEFT JOIN m ON analysis_id = a.id ORDER BY risk_score DESC NULLS LAST, a.id LIMIT 15",
    "riskiest_segments": f"WITH {_SEGS} SELECT doc_id, idx, llm_likelihood FROM s ORDER BY llm_likelihood DESC, doc_id, idx LIMIT 25",
    "rate_limit_windows": "SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) // 3600000000 * 3600 AS window_start, count(*) AS hits, greatest(0, count(*) - 2) AS rejected FROM events GROUP BY ALL",
    "daily_limit": """WITH x AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 86400000000 * 86400 AS window_start, row_number() OVER (PARTITION BY user_id, epoch_us(CAST(ts AS TIMESTAMP)) // 86400000000 ORDER BY ts, event_id) AS k FROM events)
      SELECT event_id, window_start, CAST(greatest(0, 5 - k) AS INTEGER) AS remaining, k <= 5 AS allowed FROM x""",
    "metrics_upsert": f"WITH {_ANALYSES} SELECT analysis_id, CASE WHEN analysis_id LIKE '%4' THEN 0.5 ELSE risk_score END AS risk_score, created_at FROM m",
    "workspace_upsert": f"WITH {_ANALYSES} SELECT workspace_id AS id, min(created_at) AS created_at, max(created_at) AS last_seen_at FROM a GROUP BY workspace_id",
    "segments_replace": f"WITH {_SEGS}, x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.25 ELSE llm_likelihood END AS v FROM s WHERE doc_id % 5 <> 0 OR idx < 2) SELECT doc_id, count(*) AS n, round(sum(v), 6) AS total FROM x GROUP BY doc_id",
    "delete_cascade": f"WITH {_ANALYSES} SELECT 'analyses' AS name, count(*) AS n FROM a WHERE workspace_id <> 'w5' UNION ALL SELECT 'analysis_metrics', count(*) FROM m JOIN a ON a.id = analysis_id WHERE workspace_id <> 'w5'",
    "job_transition": f"""WITH {_ANALYSES} SELECT id, CASE status WHEN 'pending' THEN 'running' WHEN 'running' THEN 'error' ELSE status END AS status, attempts + CAST(status = 'pending' AS INTEGER) AS attempts,
      CASE WHEN status = 'pending' THEN created_at + 9000 ELSE started_at END AS started_at, CASE WHEN status = 'running' THEN created_at + 9000 ELSE completed_at END AS completed_at, CASE WHEN status = 'running' THEN 'timed out' ELSE error END AS error FROM a""",
    "latest_state": f"WITH {_ANALYSES} SELECT analysis_id, id, type FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, id DESC) AS k FROM ev) WHERE k = 1",
    "report_documents": f"WITH {_ANALYSES} SELECT 'r' || a.id AS id, status, risk_score, watermark_label FROM a LEFT JOIN m ON analysis_id = a.id WHERE status IN ('done', 'error')",
    "input_validation": """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 13 = 0 THEN 'slow' ELSE 'quick' END AS mode FROM documents)
      SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'empty text' WHEN length(text) > 5000 THEN 'text too long' WHEN mode = 'slow' THEN 'unknown mode' END AS refused FROM x""",
    "json_strings": "SELECT event_id, event_type || chr(10) || props AS text FROM events WHERE props IS NOT NULL",
    "conversation_join": "SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id",
}

# -- look-ups, checks, sweeps and what surrounds an analysis ------------------------------------------------------

_BUSY = f"{_ANALYSES}, busy AS (SELECT a.* REPLACE (CAST(a.attempts + length(documents.text) % 3 AS INTEGER) AS attempts) FROM a JOIN documents ON a.id = 'a' || lpad(CAST(doc_id AS VARCHAR), 10, '0'))"
_SAID = """CASE h.category WHEN 'zero_width' THEN 'zero_width' WHEN 'bidi_control' THEN 'bidi' WHEN 'format_control' THEN 'format' WHEN 'variation_selector' THEN 'selector' WHEN 'tag_char' THEN 'tag' ELSE 'nbsp' END"""
_PARTED = """'([.!?…]+["''”’)\\]]*)(\\s+)|(\\n{2,})'"""
_HELD = f"regexp_replace(regexp_replace(text, '{_ABBREVIATED.replace('[.!?…]*[' + chr(34), '([' + chr(34)).replace(']*(' + chr(92), ']*)(' + chr(92))}', '\\1' || chr(57344) || '\\2\\3', 'g'), '{_ABBREVIATED.replace('[.!?…]*[' + chr(34), '([' + chr(34)).replace(']*(' + chr(92), ']*)(' + chr(92))}', '\\1' || chr(57344) || '\\2\\3', 'g')"

ORACLE_SQL |= {
    "provenance_manifests": """WITH x AS (SELECT doc_id, source, lang, doc_id % 9 < 3 AS missing, doc_id % 7 = 0 AS bad, CASE doc_id % 4 WHEN 0 THEN 'Trusted' WHEN 1 THEN 'Valid' WHEN 2 THEN 'Invalid' END AS st, doc_id % 5 <> 0 AS acted, doc_id % 3 AS src FROM documents),
      y AS (SELECT *, NOT missing AND NOT bad AS present, CASE WHEN acted AND src < 2 THEN src = 0 END AS ai FROM x)
      SELECT doc_id, present, CASE WHEN NOT present OR st IS NULL THEN 'unknown' WHEN st = 'Invalid' THEN 'broken' ELSE 'intact' END AS integrity, CASE WHEN NOT present OR st IS NULL OR st = 'Invalid' THEN 'unknown' WHEN st = 'Trusted' THEN 'recognised' ELSE 'unrecognised' END AS trust,
        CASE WHEN present THEN st END AS raw_state, CASE WHEN present THEN source END AS generator, CASE WHEN present THEN lang END AS signer, CASE WHEN present THEN 'CA' END AS issuer, CASE WHEN present THEN 'es256' END AS algorithm,
        CASE WHEN present THEN 'title ' || doc_id END AS title, CASE WHEN present THEN ai END AS ai_declared, CASE WHEN present AND acted THEN 'c2pa.created,c2pa.edited' ELSE '' END AS actions,
        CASE WHEN present AND st = 'Invalid' THEN 'assertion.hashedURI.mismatch' ELSE '' END AS failures, CAST(CASE WHEN present THEN CAST(coalesce(st IN ('Valid', 'Invalid'), false) AS INTEGER) + CAST(coalesce(ai, false) AS INTEGER) ELSE 0 END AS INTEGER) AS n_notes,
        CASE WHEN missing THEN 'no content credential in this file' WHEN bad THEN 'the manifest can''t be read' END AS reason FROM y""",
    "trust_anchor_count": "SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS n FROM documents",
    "feature_values": f"WITH {_PLAIN_DOCS}, {_STUDIED}, v AS (SELECT doc_id, unnest([{', '.join("{'feature': '" + k + f"', 'value': {k}}}" for k in _MEASURES)}]) AS x FROM ms) SELECT doc_id, x.feature AS feature, x.value AS value FROM v",
    "marked_pieces": f"""WITH {_HITS}, e AS (SELECT doc_id, "offset" AS o FROM hits UNION SELECT doc_id, "offset" + 1 FROM hits UNION SELECT doc_id, 0 FROM carried UNION SELECT doc_id, length(text) FROM carried), n AS (SELECT doc_id, count(*) AS m FROM hits GROUP BY doc_id)
      SELECT doc_id, count(*) - 1 AS pieces, coalesce(any_value(m), 0) AS marked, CAST(any_value(length(text)) AS BIGINT) AS chars FROM e JOIN carried USING (doc_id) LEFT JOIN n USING (doc_id) WHERE text <> '' GROUP BY doc_id""",
    "page_total": f"WITH {_ANALYSES} SELECT count(*) AS total FROM a WHERE workspace_id = 'w3' AND status = 'done'",
    "day_bars": f"WITH {_ANALYSES}, x AS (SELECT strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day, count(*) AS n FROM a WHERE created_at >= {_START + 150 * _HOUR} - 7 * 86400000 GROUP BY day) SELECT day, n, max(n) OVER () AS most, round(n / max(n) OVER (), 4) AS height FROM x",
    "summary_page": f"WITH {_ANALYSES} SELECT a.id, status, a.created_at AS submitted_at, completed_at AS finished_at, CASE WHEN CAST(substr(a.id, 2) AS BIGINT) % 4 = 0 THEN 'file' ELSE 'text' END AS title, risk_score AS risk, coalesce(watermark_label, 'none') AS verdict FROM a LEFT JOIN m ON analysis_id = a.id WHERE workspace_id = 'w2'",
    "analysis_lookup": f"WITH {_ANALYSES} SELECT id, workspace_id, status, text_sha256 FROM a WHERE id = 'a0000000010' AND workspace_id = 'w3'",
    "prefix_lookup": "SELECT min('uploads/w3/' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS path FROM documents WHERE doc_id % 7 = 3",
    "upload_checks": """WITH x AS (SELECT doc_id, (['notes.TXT', 'pa_ge.html', 'scan.pdf', 'archive.zip', 'no extension', 'table.csv', 'odd.json', 'upload.txt'])[doc_id % 8 + 1] AS clean_name, (['txt', 'html', 'pdf', 'zip', '', 'csv', 'json', 'txt'])[doc_id % 8 + 1] AS extension,
      CASE WHEN doc_id % 12 = 5 THEN 0 ELSE strlen(text) END AS size FROM documents) SELECT doc_id, clean_name, extension, CASE WHEN extension IN ('zip', '') THEN 'unsupported file type' WHEN size > 9000 THEN 'file too large' WHEN size = 0 THEN 'empty file' END AS refused FROM x""",
    "result_cache": "WITH x AS (SELECT doc_id AS id, doc_id % 2 = 0 AND doc_id % 6 <> 0 AND doc_id % 10 <> 0 AND doc_id % 9 < 6 AS hit FROM documents) SELECT id, CASE WHEN hit THEN '{\"cached\": ' || id || '}' ELSE '{\"stored\": ' || id || '}' END AS result, hit AS from_cache FROM x",
    "marker_watermark": "WITH p AS (SELECT doc_id, string_split(text, ' ') AS ps FROM documents) SELECT doc_id, sha256(array_to_string(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN x WHEN (i - 1) % 9 = 0 THEN ' ' || chr(8203) || x WHEN (i - 1) % 14 = 0 THEN ' ' || chr(8205) || x ELSE ' ' || x END), '')) AS sha256 FROM p",
    "mark_requests": """WITH x AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 120 + 1 AS n, doc_id % 140 AS t, doc_id % 5 = 0 AS odd, doc_id % 25 AS r FROM documents)
      SELECT doc_id, CASE WHEN k = 0 OR (k > 2 AND n > 100) THEN 'recipients' WHEN k = 1 THEN 'blank' WHEN k = 2 THEN 'twice' WHEN t > 128 THEN 'template' WHEN odd THEN 'channel' WHEN r < 1 OR r > 20 THEN 'repeat' END AS refused FROM x""",
    "recipient_lists": "SELECT doc_id, source || '|' || lang || '|' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'z' END AS names, doc_id % 2 = 0 OR source = lang OR source = 'z' OR lang = 'z' AS twice FROM documents",
    "distinct_copies": "SELECT doc_id, CAST(3 AS BIGINT) AS copies, CAST(3 AS BIGINT) AS distinct_texts, CAST(3 AS BIGINT) AS distinct_recipients FROM documents",
    "job_sweep": f"""WITH {_BUSY}, g AS (SELECT * FROM busy WHERE attempts >= 3 AND status IN ('pending', 'running') ORDER BY created_at, id LIMIT 25),
      r AS (SELECT * FROM busy WHERE attempts < 3 AND ((status = 'pending' AND created_at < {_START + 400 * _HOUR - 90000}) OR (status = 'running' AND started_at < {_START + 400 * _HOUR - 90000})) ORDER BY created_at, id LIMIT 5)
      SELECT id, workspace_id, 'give_up' AS action, 'error' AS "to", 'given up after ' || attempts || ' attempts' AS error, 'analysis.abandoned' AS event, 'attempts=' || attempts AS detail FROM g
      UNION ALL SELECT id, workspace_id, 'retry', 'running', NULL, 'analysis.retry', 'attempt=' || (attempts + 1) FROM r""",
    "refused_transitions": f"""WITH {_ANALYSES}, w AS (SELECT a.id, status, (['pending', 'running', 'done', 'error'])[length(documents.text) % 4 + 1] AS "to" FROM a JOIN documents ON a.id = 'a' || lpad(CAST(doc_id AS VARCHAR), 10, '0'))
      SELECT id, status, "to" FROM w WHERE NOT ((status = 'pending' AND "to" IN ('running', 'error')) OR (status = 'running' AND "to" IN ('done', 'error', 'pending'))) UNION ALL SELECT 'nobody', NULL, 'done'""",
    "failed_runs": f"""WITH {_BUSY} SELECT id, CASE WHEN attempts < 3 THEN 'pending' ELSE 'error' END AS "to", CASE WHEN attempts < 3 THEN 'analysis.retry_scheduled' ELSE 'analysis.failed' END AS event,
      CASE WHEN attempts < 3 THEN 'attempt ' || attempts || ' failed: timeout ' || id ELSE 'timeout ' || id END AS detail FROM busy WHERE status = 'running'""",
    "retry_plan": "WITH x AS (SELECT event_id, ([200, 400, 404, 408, 429, 500, 503, 504])[event_id % 8 + 1] AS status, CAST(event_id % 4 AS INTEGER) AS attempt FROM events) SELECT event_id, CAST(status AS INTEGER) AS status, attempt, status IN (408, 425, 429, 500, 502, 503, 504) AS retryable, CASE WHEN status >= 408 AND attempt < 2 THEN CAST(500 * (1 << attempt) AS INTEGER) END AS wait_ms FROM x",
    "poll_times": "WITH RECURSIVE p AS (SELECT 0 AS step, 0 AS at_ms, 1200 AS delay UNION ALL SELECT step + 1, at_ms + delay, least(CAST(floor(delay * 1.4 + 0.5) AS INTEGER), 8000) FROM p WHERE at_ms + delay <= 180000) SELECT step, at_ms FROM p",
    "insert_analyses": f"WITH {_ANALYSES} SELECT id, workspace_id, CASE WHEN status = 'done' THEN 'done' ELSE 'pending' END AS status, created_at FROM a",
    "delete_cascade_all": f"WITH {_ANALYSES}, {_SEGS} SELECT 'analyses' AS name, count(*) AS n FROM a WHERE workspace_id <> 'w5' UNION ALL SELECT 'analysis_metrics', count(*) FROM m JOIN a ON a.id = analysis_id WHERE workspace_id <> 'w5' UNION ALL SELECT 'analysis_segments', count(*) FROM s WHERE doc_id % 7 <> 5 UNION ALL SELECT 'reports', count(*) FROM a WHERE status = 'done' AND workspace_id <> 'w5'",
    "event_log": f"SELECT doc_id, 'analysis.completed' AS type, CAST(least(length(text), 1000) AS INTEGER) AS detail_chars, {_START} + doc_id AS created_at FROM documents",
    "report_checks": """WITH x AS (SELECT doc_id, trim(text[1:doc_id % 260], ' ') AS title, trim(text, ' ') AS notes, CASE WHEN doc_id % 9 = 0 THEN 'Bad Id' WHEN doc_id % 10 <> 3 THEN 'a' || doc_id END AS aid FROM documents)
      SELECT doc_id, CASE WHEN length(title) = 0 OR length(title) > 200 THEN 'title' WHEN length(notes) > 5000 THEN 'notes' WHEN aid IS NULL OR aid = 'Bad Id' THEN 'analysis_id' END AS refused FROM x""",
    "style_blend": f"""WITH {_PLAIN_DOCS}, {_STUDIED}, {_STYLED}, x AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 11) / 10.0 END AS g FROM sj)
      SELECT doc_id, CASE WHEN g IS NULL THEN style_value ELSE round(greatest(0.02, least(0.98, 0.7 * v + 0.3 * g)), 4) END AS style_value, CASE WHEN g IS NULL THEN style_low ELSE round(greatest(0.0, style_low - 0.02), 4) END AS style_low, CASE WHEN g IS NULL THEN style_high ELSE round(least(1.0, style_high + 0.02), 4) END AS style_high FROM x""",
    "surprisal_signal": """WITH x AS (SELECT doc_id, unnest(list_transform(range(1, doc_id % 40 + 2), lambda k: 2.0 + ((k * 7 + doc_id) % 13) / 4.0)) AS v FROM documents), g AS (SELECT doc_id, count(*) AS n, avg(CAST(v AS DOUBLE)) AS mean, stddev_pop(CAST(v AS DOUBLE)) / avg(CAST(v AS DOUBLE)) AS cv FROM x GROUP BY doc_id)
      SELECT doc_id, n >= 8 AS available, CASE WHEN n >= 8 THEN round(round(mean, 4), 3) END AS mean, CASE WHEN n >= 8 THEN round(round(cv, 4), 3) END AS cv, CASE WHEN n >= 8 THEN round(round(0.65 * greatest(0.0, least(1.0, (mean - 4.5) / (2.5 - 4.5))) + 0.35 * greatest(0.0, least(1.0, (cv - 0.85) / (0.55 - 0.85))), 4), 3) END AS signal FROM g""",
    "heat_alpha": f"WITH {_SEGS} SELECT doc_id, idx, round(0.08 + 0.32 * abs(llm_likelihood - 0.5) * 2, 3) AS alpha, CAST(least(end_offset, 1000) AS INTEGER) AS shown FROM s",
    "analysis_warnings": f"{_RISKY} SELECT doc_id, n_words < 40 AS short, doc_id % 3 = 0 AND watermark_label IN ('clean', 'weak_indicators') AS lossy FROM an",
    "payload_spans": f"""WITH {_HITS}, f AS (SELECT doc_id, min("offset") AS lo, max("offset") AS hi, count(*) AS n FROM hits WHERE doc_id % 8 < 3 GROUP BY doc_id)
      SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'tag_characters' WHEN 1 THEN 'variation_selectors' ELSE 'zero_width_binary' END AS channel, CASE doc_id % 8 WHEN 0 THEN 'WF-' || doc_id WHEN 1 THEN 'id:' || doc_id ELSE 'key ' || doc_id || 'x' END AS text, CAST(n AS INTEGER) AS carrier_count, lo AS first_offset, hi AS last_offset FROM f""",
    "sanitize_reasons": f"WITH {_HITS} SELECT doc_id, CASE WHEN codepoint = 160 THEN 'preserved' ELSE 'removed' END AS decision, {_SAID} AS reason, count(*) AS n FROM hits h GROUP BY ALL",
    "sanitize_warnings": f"WITH {_HITS} SELECT doc_id, CAST(1 AS INTEGER) AS n, count(*) || ' characters kept because the text needs them: a mark in them would stay' AS said FROM hits WHERE codepoint = 160 GROUP BY doc_id",
    "char_context_all": ORACLE_SQL["char_context"].replace('h.doc_id, "offset",', 'h.doc_id, "offset", category,').replace(" WHERE category = 'zero_width'", ""),
    "typo_counts_all": f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s] {{2,}}')) - len(regexp_extract_all(text, '[^\\s] {{2,}}(?:[\\s]|$)')) + len(regexp_extract_all({_SPACED}, '\\s+[,;:!?](?:\\s|$)')) + len(regexp_extract_all(text, '[!?]{{2,}}|\\.{{4,}}|,{{2,}}'))
      + len(regexp_extract_all(lower(text), '[a-ząćęłńóśźż],[a-ząćęłńóśźż]')) AS INTEGER) AS slips, CAST(len(regexp_extract_all({_SPACED}, '\\s+[,;:!?](?:\\s|$)')) AS INTEGER) AS space_before FROM documents""",
    "text_layout": """SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^\\s*(#{1,6}\\s+\\S|\\*\\*[^*\\n]+\\*\\*\\s*$)')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) AS INTEGER) AS bold,
      CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS tokens, CASE WHEN length(text) <= 60 THEN text ELSE text[1:57] || '...' END AS preview FROM documents""",
    "dedup_reused_own": f"WITH {_ANALYSES}, {_NEWEST} SELECT 'n' || a.id AS id, n.id AS reused_id FROM a JOIN newest n ON n.workspace_id = a.workspace_id AND n.text_sha256 = a.text_sha256 AND n.mode = a.mode WHERE a.status = 'done'",
    "exhausted_after_two": f"WITH {_BUSY} SELECT id, status, attempts, created_at FROM busy WHERE attempts >= 2 AND status IN ('pending', 'running') ORDER BY created_at, id LIMIT 40",
    "input_validation_default": "SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'empty text' WHEN length(text) * CASE WHEN doc_id % 17 = 0 THEN 400 ELSE 1 END > 200000 THEN 'text too long' END AS refused FROM documents",
    "corpus_sources": "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM documents JOIN labels USING (doc_id)",
    "class_counts": "SELECT quality AS label, count(*) AS n, count(*) >= 50 AS enough FROM labels GROUP BY quality",
    "workspace_tokens": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'w' || doc_id END AS id FROM documents",
    "style_judged": f"WITH {_PLAIN_DOCS}, {_STUDIED}, {_STYLED} SELECT doc_id, style_value, style_label, 'prior-logistic' AS style_model, false AS style_trained FROM sj",
    "sentence_spans": f"""WITH k AS (SELECT doc_id, text, string_split(regexp_replace({_HELD}, {_PARTED}, '\\1' || chr(30) || '\\2\\3' || chr(31), 'g'), chr(30)) AS ps FROM documents),
      f AS (SELECT doc_id, text, ps, unnest(range(1, len(ps) + 1)) AS i FROM k), g AS (SELECT doc_id, text, i, CASE WHEN i = 1 THEN 0 ELSE strpos(ps[i], chr(31)) - 1 END AS gap, CASE WHEN i = 1 THEN ps[i] ELSE substr(ps[i], strpos(ps[i], chr(31)) + 1) END AS said FROM f),
      p AS (SELECT doc_id, i, text, said, sum(gap + length(said)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM g)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, CAST(stop - length(said) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", CAST(len(regexp_extract_all(said, '{_WORD}')) AS INTEGER) AS n_words FROM p WHERE regexp_matches(said, '\\S')""",
}
