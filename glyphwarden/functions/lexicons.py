"""Word lists of languages and registers.  Entries with a blank are phrases."""

from __future__ import annotations

# Stop words by language.
STOPWORDS = {
    "en": """the of and to in a is that it for on with as was be by this are at from
        or an but not have has had they you we he she his her its their our your
        which who what when where how all can will would should could there been
        more than into about over after before between while some such other""".split(),
    "pl": """i w z na do nie że się jest to a o jak po dla od przez ale czy tym te
        ten ta tego przy oraz już tylko może być są była był było były można
        gdy który która które których jego jej ich nasz wasz bardzo także jednak
        wtedy ponieważ dlatego wszystko każdy kiedy gdzie""".split(),
    "de": """der die das und ist ich nicht sie mit den von zu für auf ein eine als
        auch es an werden aus dem sich bei einer war haben nach wird wenn nur""".split(),
    "es": """el la de que y en los del se las por un para con no una su al lo como
        más pero sus le ya o este sí porque esta entre cuando muy sin sobre""".split(),
    "fr": """le de un et être avoir que pour dans ce il qui ne sur se pas plus par
        je avec tout faire son mettre autre on mais nous comme ou si leur""".split(),
}
# Letters that speak for a language.
HINTS = {"pl": "ąćęłńóśźż", "de": "äöüß", "es": "ñ¿¡", "fr": "àâçéèêëîïôùûœ"}
# First-person pronouns.
FIRST_PERSON = {
    "en": "i me my mine myself we us our ours".split(),
    "pl": "ja mnie mi mój moja moje my nas nam nasz nasza".split(),
}


def _lines(text: str) -> list[str]:
    return [line.strip() for line in text.strip().splitlines()]


# Connectives.
DISCOURSE = {
    "en": _lines("""moreover\nfurthermore\nadditionally\nconsequently\ntherefore\nhowever\nnevertheless\nnonetheless
        in conclusion\nin summary\nto summarize\noverall\nimportantly\nnotably\nspecifically\nin essence\nthat said
        on the other hand\nfirst and foremost\nit is worth noting\nit's worth noting\nit is important to note
        it's important to note\nkeep in mind\nas a result\nin other words\nby contrast\nultimately"""),
    "pl": _lines("""ponadto\nco więcej\ndodatkowo\nw rezultacie\nw konsekwencji\ndlatego też\njednakże\nniemniej jednak
        podsumowując\nreasumując\nwarto zauważyć\nwarto podkreślić\nnależy pamiętać\nnależy zauważyć\nz drugiej strony
        przede wszystkim\ninnymi słowy\nw istocie\nostatecznie\nkluczowe jest"""),
}
# The vocabulary of the assistant register.
ASSISTANT = {
    "en": """delve delving tapestry realm landscape underscore underscores pivotal crucial robust seamless seamlessly
        leverage leveraging harness navigate navigating foster fostering holistic nuanced multifaceted comprehensive
        intricate vibrant testament unlock unlocking elevate embark cornerstone paradigm synergy streamline streamlined
        empower empowering transformative myriad plethora meticulous meticulously""".split(),
    "pl": """kluczowy kluczowe kluczowym istotny istotne znaczący znacząco kompleksowy kompleksowe holistyczny
        wszechstronny innowacyjny dynamiczny efektywnie skutecznie umożliwia pozwala stanowi wykorzystać wykorzystanie
        zapewnia niezwykle fundamentalny przełomowy zoptymalizować usprawnić""".split(),
}
# Hedges.
HEDGES = {
    "en": _lines("""it depends\ngenerally speaking\nin general\ntypically\noften\nmay vary\ncan vary\nit is recommended
        it's recommended\nconsider consulting\nas an ai\ni cannot\ni can't provide\nplease note\nnote that\nkeep in mind that"""),
    "pl": _lines("""to zależy\nogólnie rzecz biorąc\nzazwyczaj\nzwykle\nmoże się różnić\nzaleca się\nwarto skonsultować
        należy pamiętać, że\nzwróć uwagę\njako sztuczna inteligencja"""),
}
# English contractions.
CONTRACTIONS = """don't doesn't didn't can't won't isn't aren't wasn't weren't haven't hasn't hadn't i'm i've i'd i'll you're
    you've you'll we're we've they're they've it's that's there's let's he's she's wouldn't shouldn't couldn't ain't gonna wanna""".split()


def singles(entries: list[str]) -> list[str]:
    return [e for e in entries if " " not in e]


def phrases(entries: list[str]) -> list[str]:
    return [e for e in entries if " " in e]
