"""English word functions: the published Porter2 stemmer, noun lemmas by suffix rules, and Treebank tokens."""

from __future__ import annotations

import re
from functools import lru_cache

V = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Exceptional forms of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffixes of steps 2 to 4 with their replacements.
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def behind(start: int) -> int:
        m = re.search(f"[{V}][^{V}]", w[start:])
        return start + m.end() if m else len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = first if first is not None else behind(0)
    return r1, behind(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(f"(^[{V}][^{V}]|[^{V}][{V}][^{V}wxY])$", w))


@lru_cache(100_000)
def stem_english(word: str) -> str:
    """Porter2 of the value in lower case, as one word."""
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if w in SPECIAL:
        return SPECIAL[w]
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    w = re.sub(f"(^|[{V}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # 1b
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for table, step in ((STEP2, 2), (STEP3, 3)):
        for s in table:
            if w.endswith(s):
                at = len(w) - len(s)
                if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in tuple("cdeghkmnrt")) and not (step == 3 and s == "ative" and at < r2):
                    w = w[:at] + table[s]
                break
    for s in STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and not (s == "ion" and w[at - 1 : at] not in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not re.search(f"([^{V}][{V}][^{V}wxY]|^[{V}][^{V}])$", w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Irregular nouns; a documented subset, as no dictionary is at hand.
IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "oxen": "ox", "diagnoses": "diagnosis", "analyses": "analysis", "crises": "crisis", "hypotheses": "hypothesis", "bacteria": "bacterium", "criteria": "criterion", "phenomena": "phenomenon", "nuclei": "nucleus", "fungi": "fungus", "vertebrae": "vertebra", "larvae": "larva", "indices": "index", "matrices": "matrix", "vertices": "vertex"}


def lemma(word: str) -> str:
    """The singular of a regular English noun by its suffix; other values stay as they are."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    for suffix, plain in (("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ies", "y")):
        if word.endswith(suffix) and len(word) > len(suffix) + 1:
            return word[: -len(suffix)] + plain
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        return word[:-1]
    return word


# Substitutions of the published Penn Treebank tokenization, in their order.
TREEBANK = [
    (r"^\"", r"``"), (r"(``)", r" \1 "), (r"([ (\[{<])(\"|'{2})", r"\1 `` "),
    (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", r" ... "), (r"[;@#$%&]", r" \g<0> "),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", r"\1 \2\3 "), (r"[?!]", r" \g<0> "), (r"([^'])' ", r"\1 ' "),
    (r"[\]\[\(\)\{\}\<\>]", r" \g<0> "), (r"--", r" -- "),
]
ENDING = [(r"''", " '' "), (r"\"", " '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 ")]
JOINED = [r"(?i)\b(can)(not)\b", r"(?i)\b(d)('ye)\b", r"(?i)\b(gim)(me)\b", r"(?i)\b(gon)(na)\b", r"(?i)\b(got)(ta)\b", r"(?i)\b(lem)(me)\b", r"(?i)\b(more)('n)\b", r"(?i)\b(wan)(na)\s", r"(?i) ('t)(is)\b", r"(?i) ('t)(was)\b"]


def treebank(text: str) -> list[str]:
    for pattern, out in TREEBANK:
        text = re.sub(pattern, out, text)
    text = f" {text} "
    for pattern, out in ENDING:
        text = re.sub(pattern, out, text)
    for pattern in JOINED:
        text = re.sub(pattern, r" \1 \2 ", text)
    return text.split()
