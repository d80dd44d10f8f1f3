"""The rules of controlled errors in plain Python, by places of tokens: what the column expressions are held against."""

import re

from loomtext.functions.perturb import ADDED, ANTONYMS, FAMILIES, GENERIC, GENERIC_PREFIX, IMAGES, PRONOUNS, SPEECH, STOPWORDS

_TOKEN, _NEGATION = re.compile(r"\b[\w'-]+\b"), re.compile(r"\b(not|no|never|nor)\b", re.I)


class _Line:
    """A text with the places of its tokens, and the edits that rules are made of."""

    def __init__(self, text: str):
        self.text = text
        self.at = [m.span() for m in _TOKEN.finditer(text)]
        self.low = [text[i:j].lower() for i, j in self.at]

    def put(self, k: int, word: str) -> str:
        i, j = self.at[k]
        return self.text[:i] + word + self.text[j:]

    def swap(self, k: int, n: int) -> str | None:
        if max(k, n) >= len(self.at):
            return None
        (a, b), (c, d) = self.at[min(k, n)], self.at[max(k, n)]
        t = self.text
        return t[:a] + t[c:d] + t[b:c] + t[a:b] + t[d:]

    def first(self, table) -> int | None:
        return next((k for k, w in enumerate(self.low) if w in table), None)

    def replaced(self, table: dict[str, str]) -> str | None:
        k = self.first(table)
        return None if k is None else self.put(k, table[self.low[k]])


def _negation(s: _Line):
    m = _NEGATION.search(s.text)
    return (s.text[: m.start()] + s.text[m.end() :]).strip() if m else "not " + s.text


def _number(s: _Line):
    i, j = s.at[-1]
    word = s.text[i:j]
    return s.put(-1, word[:-1] if word.endswith("s") else word + "s")


def _technical(s: _Line):
    k = next((k for k, (i, _) in enumerate(s.at) if s.text[i].isupper()), None)
    return GENERIC_PREFIX + s.text if k is None else s.put(k, GENERIC)


def _image(s: _Line):
    return next((s.put(s.low.index(word), flat) for word, flat in IMAGES.items() if word in s.low), None)


def _speaker(s: _Line):
    k = s.first(SPEECH)
    return None if k is None else s.put(k, "said" if s.low[k] == "asked" else "asked")


def _omission(s: _Line):
    """Without the last clause, if a comma parts one off and the whole text has more than 3 tokens; else without the last token."""
    head, comma, clause = s.text.rpartition(",")
    if comma and clause.strip() and len(s.at) > 3:
        return head.rstrip(" ,")
    return s.text[: s.at[-1][0]].rstrip() if len(s.at) > 1 else None


def _mistranslation(s: _Line):
    swapped = s.replaced(ANTONYMS)
    if swapped is None and len(s.at) > 1:
        i, j = s.at[1]
        return s.put(1, s.text[i:j][::-1])
    return swapped


def _roles(s: _Line):
    content = [k for k, w in enumerate(s.low) if w not in STOPWORDS]
    return s.swap(content[0], content[-1]) if len(content) > 1 else s.swap(0, 1)


def _boundary(s: _Line):
    for k, (i, j) in enumerate(s.at):
        joined = s.text[i:j].replace("-", "")
        if "-" in s.text[i:j] and len(joined) > 3:
            return s.put(k, joined)
    return None


def _style(s: _Line):
    return (s.text[0].lower() + s.text[1:]).strip() if s.text[0].isupper() else None


RULES = {
    "SCOPE_NEGATION": _negation,
    "MORPHOLOGY": _number,
    "TECHNICAL_TERM": _technical,
    "POETIC_METAPHOR": _image,
    "TEXTUAL_STRUCTURE": _speaker,
    "ACCURACY_OMISSION": _omission,
    "ACCURACY_ADDITION": lambda s: (s.text + ADDED).strip(),
    "ACCURACY_MISTRANSLATION": _mistranslation,
    "SYNTAX_KARAKA": _roles,
    "LEXICAL_SENSE": lambda s: s.replaced(ANTONYMS),
    "COREFERENCE": lambda s: s.replaced(PRONOUNS),
    "COMPOUND_SAMASA": lambda s: s.swap(0, 1),
    "SEGMENTATION_SANDHI": _boundary,
    "STYLE": _style,
}


def perturb(text: str | None, family: str) -> str | None:
    line = _Line(text or "")
    return RULES[family](line) if line.at else None
