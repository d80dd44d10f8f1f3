"""Tagging texts by lexicons: traditions, schools, term density. Lexicons are parameters; the defaults are below."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints of traditions, in the order that breaks ties; a hint listed twice counts twice.
DEFAULT_TRADITION = "Vedic/General"
TRADITIONS = {
    "Pratyabhijñā/Trika": ("pratyabhijñā", "pratyabhijna", "trika", "śiva sūtra", "sivasutra", "spanda", "vimarśa", "aham", "caitanya", "māyā", "maya", "icchā", "jñānaśakti", "unmesa", "prakāśa", "vimarśa"),
    "Krama": ("krama", "sādhāra", "mātṛkā", "unmanī", "ānanda", "ananda", "śakti-pāta", "ucyate"),
    "Śaiva Siddhānta": ("siddhānta", "siddhanta", "pāśa", "pāsa", "mala", "bheda", "pramātṛ", "pramatr", "ṛṇa", "adhvā", "tattva", "kalā", "vidyā"),
    "Vedic/General": ("gītā", "gita", "brahma", "veda", "upaniṣad", "upanisad", "ātman", "dharma"),
}
# Fragments of file names by school, in the order of precedence.
SCHOOL_FRAGMENTS = {
    "Pratyabhijñā/Trika": ("abhinavagupta-", "kramastotra", "paryantapaJcAzikA", "anuttarASTikA", "paramArthasAra", "mAlinIzlokavArttika", "ziva", "svacchanda", "vijaya", "kubjika", "vInAzikha"),
    "Śaiva Siddhānta": ("siddhAnta", "tantra", "mata", "nibandha", "zivadRSTi"),
    "Krama": ("krama", "mAtRkA", "unmanI", "Ananda"),
    "Vedānta": ("vedAnta", "brahmasUtra", "siddhAntabindu", "upaniSad", "gauda", "zaGkara", "vivaraNa"),
    "Nyāya": ("nyAya", "pramANa", "anumAna", "tarka", "vAda", "hetu", "bAdarAyaNa"),
    "Yoga": ("yoga", "sAMkhya", "kArikA", "pataJjali"),
    "Buddhist": ("buddha", "sUtra", "mahAyAna", "jAtaka", "avadAna", "prajJA", "dharmakIrti", "asaGga", "kArikA", "mAdhyamaka", "nAgArjuna", "vijJapti", "zAntideva"),
}
# Difficulty tier and period by school.
DEFAULT_TIER, DEFAULT_PERIOD, UNCLASSIFIED = 2, "Epic", "Unclassified"
SCHOOL_TIER = {"Pratyabhijñā/Trika": 4, "Śaiva Siddhānta": 4, "Krama": 4, "Nyāya": 3, "Vedānta": 3, "Yoga": 3, "Buddhist": 3}
SCHOOL_PERIOD = {"Pratyabhijñā/Trika": "Tantric", "Śaiva Siddhānta": "Tantric", "Krama": "Tantric", "Nyāya": "Classical", "Vedānta": "Classical", "Yoga": "Classical", "Buddhist": "Classical"}
# Specialist terms by school.
SCHOOL_TERMS = {
    "Pratyabhijñā/Trika": ("vimarśa", "prakāśa", "śakti", "icchā", "jñānaśakti", "kriyāśakti", "svātantrya", "pratyabhijñā", "aham", "caitanya", "unmeṣa", "sphurattā", "viśrānti", "ābhāsa", "śambhu"),
    "Śaiva Siddhānta": ("pāśa", "mala", "bheda", "pramātṛ", "adhvā", "tattva", "kalā", "vidyā", "kriyā", "dīkṣā", "nirodha", "māyā", "āṇava", "kārmika", "māyīya"),
    "Krama": ("krama", "mātṛkā", "unmanī", "ānanda", "sādhāra", "icchā", "śakti-pāta", "ucyate", "anuttara", "saṃvit", "akula"),
    "Vedānta": ("brahman", "ātman", "māyā", "avidyā", "jñāna", "bhakti", "mokṣa", "saguṇa", "nirguṇa", "āvaraṇa", "vikṣepa", "adhyāsa", "sat-cit-ānanda"),
    "Nyāya": ("pramāṇa", "anumāna", "pratyakṣa", "śabda", "upamāna", "hetu", "vyāpti", "pakṣa", "sādhya", "dṛṣṭānta", "nigraha", "tarka", "āpatti", "prasaṅga"),
    "Yoga": ("yoga", "samādhi", "dhyāna", "dhāraṇā", "kriyā", "viveka", "kaivalya", "puruṣa", "prakṛti", "guṇa", "sattva", "rajas", "tamas"),
    "Buddhist": ("śūnyatā", "prajñā", "upāya", "dharma", "nirvāṇa", "skandha", "kṣaṇikatva", "pratītyasamutpāda", "bodhicitta", "śīla", "samādhi", "vijñapti", "mādhya", "śrotra"),
}
# Fixed value: letters of a token when terms are counted.
LETTERS = "[a-zA-Zāīūṛṝḷḹṃṁñṅśṣṭḍḥ]+"
# Families of errors that a judgment may name, in order.
ERROR_FAMILIES = ("compound semantic loss", "case-role inversion", "negation loss", "implicit subject", "technical-term substitution", "scope loss", "metaphor literalisation", "dropped pāda")


def _holds(text: str, parts: tuple[str, ...]) -> list[str]:
    """Whether a column holds each part, as SQL: one expression of many parts is made in a hundredth of the time that one column for each takes."""
    quoted = (p.replace("\\", "\\\\").replace("'", "\\'") for p in parts)
    return [f"contains({text}, '{p}')" for p in quoted]


def hint_score(low: Column | str, hints: tuple[str, ...]) -> Column:
    """How many hints a lower-case text, or the column of that name, holds; those with other letters are looked for only in texts that have such letters."""
    if isinstance(low, str):
        held = lambda some: F.expr(" + ".join(["0", *(f"cast({h} AS int)" for h in _holds(low, some))]))
    else:
        held = lambda some: sum((low.contains(h).cast("int") for h in some), F.lit(0))
    plain, other = [h for h in hints if h.isascii()], [h for h in hints if not h.isascii()]
    return held(plain) + F.when(F.octet_length(low) > F.length(low), held(other)).otherwise(0) if other else held(plain)


def tag(text: Column | str, lexicon: dict[str, tuple[str, ...]] = TRADITIONS, default: str = DEFAULT_TRADITION) -> Column:
    """The class with most hints in the text, or in the column of that name, which holds lower-case text; the earlier class wins a tie, the default a text without hints. Classes are scored once: nothing but the best one's name is asked for."""
    low = text if isinstance(text, str) else F.lower(F.coalesce(text, F.lit("")))
    scored = lambda n, first, name: F.struct(n.alias("n"), F.lit(first).alias("first"), F.lit(name).alias("name"))
    return F.array_max(F.array(scored(F.lit(0), 1, default), *(scored(hint_score(low, hints), -k, name) for k, (name, hints) in enumerate(lexicon.items()))))["name"]


def detect(name: Column | str, fragments: dict[str, tuple[str, ...]] = SCHOOL_FRAGMENTS) -> Column:
    """The first class of which a fragment occurs in the name, or in the column of that name; null if none."""
    out = None
    for label, parts in fragments.items():
        hit = F.expr(" OR ".join(["false", *_holds(name, parts)])) if isinstance(name, str) else reduce(or_, (name.contains(p) for p in parts), F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def term_density(text: Column, terms: tuple[str, ...], letters: str = LETTERS) -> Column:
    """struct(n_terms, n_tokens, term_density, found): tokens that begin with a term of four letters or more, or with which, at four letters or more, a term begins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(letters), 0)
    lower = [t.lower() for t in terms]

    def is_term(tok: Column) -> Column:
        hit = F.lit(False)
        for t in lower:
            if len(t) >= 4:
                hit = hit | tok.startswith(t)
            hit = hit | ((F.length(tok) >= 4) & F.lit(t).startswith(tok))
        return hit

    n, hits = F.size(tokens), F.size(F.filter(tokens, is_term))
    found = F.filter(F.array(*[F.when(low.contains(t.lower()), t) for t in terms]), lambda x: x.isNotNull())
    return F.struct(hits.alias("n_terms"), n.alias("n_tokens"), F.when(n > 0, F.round(hits / n, 4)).otherwise(0.0).alias("term_density"), found.alias("found"))


def error_family(judgment: Column) -> Column:
    """The first known family whose first word the judgment contains, else "novel"."""
    low = F.lower(F.coalesce(judgment, F.lit("")))
    out = F.when(low.contains(ERROR_FAMILIES[0].split()[0]), ERROR_FAMILIES[0])
    for family in ERROR_FAMILIES[1:]:
        out = out.when(low.contains(family.split()[0]), family)
    return out.otherwise("novel")
