"""Deterministic checks of a candidate against its source, and the gate over all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import SPACE, diacritics, pair_hash, words

# Accepted renderings of technical terms.
GLOSSARY = {
    "śiva": ("Shiva", "Śiva"),
    "śakti": ("Shakti", "Śakti", "power"),
    "māyā": ("Maya", "Māyā", "illusion"),
    "ātman": ("Self", "Ātman", "self"),
    "brahman": ("Brahman", "brahman"),
    "jñāna": ("knowledge", "Jñāna"),
    "karma": ("karma", "Karma"),
    "dharma": ("dharma", "Dharma"),
    "nirvāṇa": ("nirvana", "Nirvana", "Nirvāṇa"),
    "yoga": ("yoga", "Yoga"),
    "puruṣa": ("purusha", "Puruṣa", "person"),
    "prakṛti": ("prakriti", "Prakṛti", "nature"),
}
# The checks in the order in which a gate names those that fail, and their limits.
CHECKS = ("SOURCE_BINDING", "COVERAGE", "ABSTENTION", "TERM_CONSISTENCY", "CITATION_GROUNDING")
MOST_RATIO, LEAST_RATIO, MOST_DIACRITICS, ABSTAIN_LENGTH, LEAST_GOLD = 3.5, 0.4, 5, 40, 0.3


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def binding_ratio(source: Column, candidate: Column) -> Column:
    """Candidate words over source words, both of more than two characters, source words without a digit; null without source words."""
    src = F.size(F.filter(F.split(_text(source), SPACE), lambda t: (F.length(t) > 2) & ~t.rlike(r"\p{Nd}")))
    cand = F.size(F.filter(F.split(_text(candidate), SPACE), lambda t: F.length(t) > 2))
    return F.when(src > 0, cand / src)


def source_bound(source: Column, candidate: Column) -> Column:
    return F.coalesce(binding_ratio(source, candidate) <= MOST_RATIO, F.lit(False))


def coverage_ratio(source: Column, candidate: Column) -> Column:
    src = F.size(words(source))
    return F.when(src > 0, F.size(words(candidate)) / src)


def covered(source: Column, candidate: Column) -> Column:
    return F.coalesce(coverage_ratio(source, candidate) >= LEAST_RATIO, F.lit(False))


def translated(candidate: Column) -> Column:
    """False if the candidate is long and still transliterated."""
    return ~((diacritics(_text(candidate)) > MOST_DIACRITICS) & (F.length(_text(candidate)) > ABSTAIN_LENGTH))


def _used(candidate: Column, renderings: tuple[str, ...]) -> list[Column]:
    """For each distinct lower-cased rendering whether the candidate contains it."""
    low = F.lower(_text(candidate))
    return [low.contains(r) for r in dict.fromkeys(r.lower() for r in renderings)]


def consistent(candidate: Column, glossary: dict[str, tuple[str, ...]] = GLOSSARY) -> Column:
    """No term is rendered in two ways."""
    mixed = F.lit(False)
    for renderings in glossary.values():
        used = _used(candidate, renderings)
        if len(used) > 1:
            mixed = mixed | (sum((u.cast("int") for u in used), F.lit(0)) > 1)
    return ~mixed


def ungrounded(source: Column, candidate: Column, glossary: dict[str, tuple[str, ...]] = GLOSSARY) -> Column:
    """Terms that the candidate renders although the source neither contains them nor has a word of four letters or more with their first three."""
    low = F.lower(_text(source))
    long_words = F.filter(F.split(low, SPACE), lambda t: F.length(t) >= 4)
    out = []

    def begun(start: str) -> Column:
        return F.exists(long_words, lambda t: t.startswith(start))

    for term, renderings in glossary.items():
        used = F.lit(False)
        for u in _used(candidate, renderings):
            used = used | u
        grounded = low.contains(term) | begun(term[:3])
        out.append(F.when(used & ~grounded, term))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def blocking(source: Column, candidate: Column, glossary: dict[str, tuple[str, ...]] = GLOSSARY) -> Column:
    """The names of the checks that fail, in fixed order."""
    passed = (source_bound(source, candidate), covered(source, candidate), translated(candidate), consistent(candidate, glossary), F.size(ungrounded(source, candidate, glossary)) == 0)
    return F.filter(F.array(*[F.when(~ok, name) for name, ok in zip(CHECKS, passed)]), lambda x: x.isNotNull())


def gate(blocked: Column) -> Column:
    return F.when(F.size(blocked) == 0, "PASS").otherwise("BLOCKED")


def result_id(source: Column, candidate: Column) -> Column:
    """A stable id of a pair (the same pair always has the same)."""
    return pair_hash(F.concat_ws("\u0001", pair_hash(_text(source)), F.substring(_text(candidate), 1, 40)))


def decision(gate_col: Column) -> Column:
    return F.when(gate_col == "PASS", "accepted").otherwise("review")


def gold_ok(chrf: Column, has_gold: Column) -> Column:
    return F.when(has_gold, chrf >= LEAST_GOLD).otherwise(True)


def epistemic_kind(verified: Column, derived: Column, observed: Column) -> Column:
    return F.when(verified, "VERIFIED").when(derived, "DERIVED").when(observed, "OBSERVED").otherwise("DECLARED")


def severity_weight(severity: Column) -> Column:
    """Fixed values of annotation severities."""
    return F.when(severity == "minor", 1).when(severity == "major", 5).when(severity == "critical", 25)


def host_verdict(free_gib: Column) -> Column:
    return F.when(free_gib >= 1.0, "SAFE").when(free_gib < 0.4, "CRITICAL").otherwise("CAUTION")
