"""Controlled errors: one rule for each family of errors turns a good translation into a bad one, or into null where it has no hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import strip

# Families in the order of application, each with its instruction.
FAMILIES = {
    "SCOPE_NEGATION": "Perturb the translation so a negation marker is removed or inverted (a controlled bad translation).",
    "MORPHOLOGY": "Perturb the translation so a number (singular/plural) is swapped (a controlled bad translation).",
    "TECHNICAL_TERM": "Perturb the translation so a technical term is mistranslated as a generic word (a controlled bad translation).",
    "POETIC_METAPHOR": "Perturb the translation so a metaphor is flattened to a literal statement (a controlled bad translation).",
    "TEXTUAL_STRUCTURE": "Perturb the translation so the quoted speaker / quotation boundary is confused (a controlled bad translation).",
    "ACCURACY_OMISSION": "Perturb the translation by dropping a content element (a controlled bad translation).",
    "ACCURACY_ADDITION": "Perturb the translation by adding content not in the source (a controlled bad translation).",
    "ACCURACY_MISTRANSLATION": "Perturb the translation so a source element is rendered incorrectly (a controlled bad translation).",
    "SYNTAX_KARAKA": "Perturb the translation so an agent/patient (who does what to whom) is swapped (a controlled bad translation).",
    "LEXICAL_SENSE": "Perturb the translation so a polysemous term is given the wrong sense (a controlled bad translation).",
    "COREFERENCE": "Perturb the translation so a pronoun / implicit subject refers to the wrong entity (a controlled bad translation).",
    "COMPOUND_SAMASA": "Perturb the translation so a compound / phrase is re-ordered to the wrong head (a controlled bad translation).",
    "SEGMENTATION_SANDHI": "Perturb the translation so a word boundary is split wrongly (a controlled bad translation).",
    "STYLE": "Perturb the translation into a mismatched register (a controlled bad translation).",
}
# Words and what takes their place, by rule.
ANTONYMS = {
    "good": "evil", "great": "small", "divine": "ordinary", "eternal": "temporary", "supreme": "inferior", "wise": "foolish", "pure": "impure", "many": "few", "whole": "partial", "bright": "dark",
    "true": "false", "final": "initial", "inner": "outer", "highest": "lowest", "all": "none", "beloved": "hated", "liberated": "bound", "auspicious": "inauspicious", "wicked": "good", "first": "last",
    "beginning": "end", "begin": "end", "victory": "defeat", "victorious": "defeated", "immortal": "mortal", "happy": "sad", "pleasure": "pain", "love": "hatred", "fear": "courage", "birth": "death",
    "entered": "left", "came": "left", "gives": "takes", "given": "taken", "comes": "leaves", "knows": "ignores", "free": "bound", "within": "without", "above": "below", "large": "small", "praise": "blame", "honored": "dishonored",
}
IMAGES = {"abode": "building", "flame": "fire", "light": "lamp", "heart": "organ", "lamp": "object", "ocean": "water"}
PRONOUNS = {"his": "her", "her": "his", "its": "their", "their": "its"}
SPEECH = ("said", "replied", "spoke", "asked", "declared", "says", "saying", "told")
STOPWORDS = frozenset(
    "the a an of in to and or with by from at for is are was were be been this that these those as on his her its their my your our i you he she it we they not no never nor but so me him us them all".split()
)
ADDED, GENERIC, GENERIC_PREFIX = ", and this was not stated in the original text", "the being", "the thing (term left generic) "

# What a token and a negation look like: whole runs of letters, digits and underscores, tokens also with ' and - inside.
_CHAR = r"[\p{L}\p{N}_]"
_TOKEN, _NEGATION = rf"{_CHAR}(?:[\p{{L}}\p{{N}}_'-]*{_CHAR})?", rf"(?<!{_CHAR})(?i:not|no|never|nor)(?!{_CHAR})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it: a lambda's variable is never put in place of what it stands for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Line:
    """A text as tokens `t`, those in lower case `low`, and the gaps around them `g`, so that it is g1 t1 g2 t2 .. g(n + 1); and the edits that rules are made of. Tokens count from 1."""

    def __init__(self, line: Column):
        self.text, self.t, self.low, self.g = (line[c] for c in ("text", "t", "low", "g"))
        self.n = F.size(self.t)
        self.places = F.sequence(F.lit(1), self.n)

    @staticmethod
    def of(text: Column) -> Column:
        t = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
        return F.struct(text.alias("text"), t.alias("t"), F.transform(t, F.lower).alias("low"), F.split(text, _TOKEN, -1).alias("g"))

    def word(self, k: Column, low: bool = False) -> Column:
        return F.get(self.low if low else self.t, k - 1)

    def _joined(self, token: Callable[[Column], Column], to: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), to), lambda i: F.concat(F.get(self.g, i - 1), token(i))), "")

    def put(self, k: Column, word: Callable[[Column], Column]) -> Column:
        """The text with word(k) in the k-th token's place; null if k is."""
        told = lambda k: self._joined(lambda i: F.when(i == k, word(k)).otherwise(self.word(i)), self.n)
        return let(k, lambda k: F.when(k.isNotNull(), F.concat(told(k), F.get(self.g, self.n))))

    def swap(self, a: Column, b: Column) -> Column:
        """The text with two tokens in each other's place; null where there is no b-th one."""
        other = lambda p, i: F.when(i == p["a"], self.word(p["b"])).when(i == p["b"], self.word(p["a"])).otherwise(self.word(i))
        told = lambda p: F.concat(self._joined(lambda i: other(p, i), self.n), F.get(self.g, self.n))
        return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(p["b"] <= self.n, told(p)))

    def first(self, fits: Callable[[Column], Column]) -> Column:
        """The first place that fits, null if none."""
        return F.get(F.filter(self.places, fits), F.lit(0))

    def replaced(self, table: dict[str, str]) -> Column:
        other = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return self.put(self.first(lambda i: self.word(i, True).isin(*table)), lambda k: other[self.word(k, True)])

    def before_last(self) -> Column:
        """The text up to its last token."""
        return F.when(self.n > 1, F.concat(self._joined(self.word, self.n - 1), F.get(self.g, self.n - 1)))


def _negation(s: _Line) -> Column:
    once = F.regexp_replace(s.text, rf"(?s)\A(.*?){_NEGATION}(.*)\z", "$1$2")
    return F.when(s.text.rlike(_NEGATION), strip(once)).otherwise(F.concat(F.lit("not "), s.text))


def _number(s: _Line) -> Column:
    return s.put(s.n, lambda k: F.regexp_replace(F.concat(s.word(k), F.lit("s")), r"ss\z", ""))  # one s more, or one less


def _technical(s: _Line) -> Column:
    start = lambda i: F.substring(s.word(i), 1, 1)
    return F.coalesce(s.put(s.first(lambda i: F.lower(start(i)) != start(i)), lambda k: F.lit(GENERIC)), F.concat(F.lit(GENERIC_PREFIX), s.text))


def _image(s: _Line) -> Column:
    where = F.coalesce(*(F.nullif(F.array_position(s.low, w), F.lit(0)) for w in IMAGES)).cast("int")
    flat = F.create_map(*[F.lit(x) for pair in IMAGES.items() for x in pair])
    return s.put(where, lambda k: flat[s.word(k, True)])


def _speaker(s: _Line) -> Column:
    return s.put(s.first(lambda i: s.word(i, True).isin(*SPEECH)), lambda k: F.when(s.word(k, True) == "asked", "said").otherwise("asked"))


def _omission(s: _Line) -> Column:
    """Without the last clause, if a comma parts one off and the whole text has more than 3 tokens; else without the last token."""
    clause = F.regexp_extract(s.text, r"(?s),([^,]*)\z", 1)
    head = F.regexp_replace(F.regexp_replace(s.text, r"(?s),[^,]*\z", ""), r"[ ,]+\z", "")
    return F.when((strip(clause) != "") & (s.n > 3), head).otherwise(F.regexp_replace(s.before_last(), r"(?U)\s+\z", ""))


def _mistranslation(s: _Line) -> Column:
    return F.coalesce(s.replaced(ANTONYMS), F.when(s.n > 1, s.put(F.lit(2), lambda k: F.reverse(s.word(k)))))


def _roles(s: _Line) -> Column:
    content = F.filter(s.places, lambda i: ~s.word(i, True).isin(*sorted(STOPWORDS)))
    return let(content, lambda c: F.when(F.size(c) > 1, s.swap(F.get(c, F.lit(0)), F.get(c, F.size(c) - 1))).otherwise(s.swap(F.lit(1), F.lit(2))))


def _boundary(s: _Line) -> Column:
    whole = lambda i: F.replace(s.word(i), F.lit("-"), F.lit(""))
    return s.put(s.first(lambda i: F.contains(s.word(i), F.lit("-")) & (F.length(whole(i)) > 3)), whole)


def _style(s: _Line) -> Column:
    start = F.substring(s.text, 1, 1)
    return F.when(F.lower(start) != start, strip(F.concat(F.lower(start), F.substring(s.text, 2, 2**31 - 1))))


RULES: dict[str, Callable[[_Line], Column]] = {
    "SCOPE_NEGATION": _negation,
    "MORPHOLOGY": _number,
    "TECHNICAL_TERM": _technical,
    "POETIC_METAPHOR": _image,
    "TEXTUAL_STRUCTURE": _speaker,
    "ACCURACY_OMISSION": _omission,
    "ACCURACY_ADDITION": lambda s: strip(F.concat(s.text, F.lit(ADDED))),
    "ACCURACY_MISTRANSLATION": _mistranslation,
    "SYNTAX_KARAKA": _roles,
    "LEXICAL_SENSE": lambda s: s.replaced(ANTONYMS),
    "COREFERENCE": lambda s: s.replaced(PRONOUNS),
    "COMPOUND_SAMASA": lambda s: s.swap(F.lit(1), F.lit(2)),
    "SEGMENTATION_SANDHI": _boundary,
    "STYLE": _style,
}


def all_perturbations(text: Column) -> Column:
    """An array with the bad text of each family, in the order of FAMILIES, null where a rule has no hold; a text without a token, or null, has none of any.

    Expressions alone: a text is cut into tokens once, and what a rule looks for is found once.
    """
    none = F.array(*[F.lit(None).cast("string")] * len(FAMILIES))
    made = lambda line: F.array(*(RULES[f](_Line(line)) for f in FAMILIES))
    return let(_Line.of(F.coalesce(text, F.lit(""))), lambda line: F.when(F.size(line["t"]) > 0, made(line)).otherwise(none))


def instruction(family: str) -> str:
    return FAMILIES[family]
