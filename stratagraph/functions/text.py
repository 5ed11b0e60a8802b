"""Words for full-text search: tokens, folding, and stems of English, German, French and Spanish."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from ..errors import ConfigDrift

TOKEN = re.compile(r"[^\W_]+")
#: Words whose forms a worker keeps at hand: the frequent ones stay, whatever the vocabulary.
CACHED = 100_000
_MARKS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]+")
#: Languages with a stemmer, by code. Other languages are refused: without their stems recall would silently be lost.
LANGUAGES = {"en": "en", "english": "en", "de": "de", "german": "de", "es": "es", "spanish": "es", "fr": "fr", "french": "fr"}


def tokens(text: str | None) -> list[str]:
    """Composed lower-case runs of letters and digits; none for null."""
    composed = unicodedata.normalize("NFC", text or "")
    return [m.group() for m in TOKEN.finditer(composed.lower())]


@lru_cache(CACHED)
def fold(token: str) -> str:
    """Without accents and compatibility forms."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", token)).lower()


def language(name: str | bool | None) -> str | None:
    """The stemmer's code of a declared language; None means words are folded only."""
    if name in (None, True, False, "none"):
        return None
    if name.lower() not in LANGUAGES:
        raise ConfigDrift(f"no stemmer for {name!r}; known: {sorted(LANGUAGES)}, or None to fold only")
    return LANGUAGES[name.lower()]


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again within R1."""
    spot = re.compile(f"[{vowels}][^{vowels}]")
    m = spot.search(word)
    r1 = m.end() if m else len(word)
    m = spot.search(word, r1)
    return r1, m.end() if m else len(word)


def _strip_first(word: str, endings: list[str], start: int) -> str | None:
    """The longest of the endings that word has, if it lies in the region from start on."""
    for e in endings:
        if word.endswith(e):
            return e if len(word) - len(e) >= start else None
    return None


# The published Snowball word and suffix lists for English. Fixed values.
_EN_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_EN_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _short(word: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def stem_en(word: str) -> str:
    """The Porter2 stem."""
    if len(word) <= 2:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    word = re.sub(r"(?<=[aeiouy])y", "Y", re.sub(r"^y", "Y", word))
    special = re.match(r"gener|commun|arsen", word)
    r1, r2 = _regions(word, "aeiouy")
    if special:
        r1 = special.end()
        m = re.compile("[aeiouy][^aeiouy]").search(word, r1)
        r2 = m.end() if m else len(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _EN_KEEP:
        return word.lower()
    for e in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(e):
            head = word[: -len(e)]
            if e in ("eed", "eedly"):
                if len(head) >= r1:
                    word = head + "ee"
            elif re.search("[aeiouy]", head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                    word = word[:-1]
                elif r1 >= len(word) and _short(word):
                    word += "e"
            break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for e, to in sorted(_EN_STEP2.items(), key=lambda x: -len(x[0])):
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= r1 and (e != "ogi" or word[at - 1 : at] == "l") and (e != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + to
            break
    for e, to in sorted(_EN_STEP3.items(), key=lambda x: -len(x[0])):
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= (r2 if e == "ative" else r1):
                word = word[:at] + to
            break
    for e in _EN_STEP4:
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= r2 and (e != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stem_de(word: str) -> str:
    """The Snowball stem for German."""
    vowels = "aeiouyäöü"
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{vowels}])u(?=[{vowels}])", "U", word)
    word = re.sub(f"(?<=[{vowels}])y(?=[{vowels}])", "Y", word)
    r1, r2 = _regions(word, vowels)
    r1 = max(r1, min(3, len(word)))
    for e in ("ern", "em", "er", "en", "es", "e", "s"):
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= r1 and (e != "s" or word[at - 1 : at] in tuple("bdfghklmnrt")):
                word = word[:at]
                if e in ("en", "es", "e") and word.endswith("niss"):
                    word = word[:-1]
            break
    for e in ("est", "en", "er", "st"):
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= r1 and (e != "st" or at >= 4 and word[at - 1] in "bdfghklmnt"):
                word = word[:at]
            break
    for e in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if word.endswith(e):
            at = len(word) - len(e)
            if at >= r2:
                if e in ("end", "ung"):
                    word = word[:at]
                    if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                        word = word[:-2]
                elif e in ("ig", "ik", "isch"):
                    if word[at - 1 : at] != "e":
                        word = word[:at]
                elif e in ("lich", "heit"):
                    word = word[:at]
                    if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                        word = word[:-2]
                else:
                    word = word[:at]
                    for x in ("lich", "ig"):
                        if word.endswith(x):
                            if len(word) - len(x) >= r2:
                                word = word[: -len(x)]
                            break
            break
    return word.lower().translate({ord("ä"): "a", ord("ö"): "o", ord("ü"): "u"})


# The published Snowball suffix lists for Spanish. Fixed values.
_ES_PRONOUNS = ["selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo"]
_ES_PLAIN = [
    "amientos", "imientos", "amiento", "imiento", "anzas", "ismos", "ables", "ibles", "istas", "anza", "icos", "icas", "ismo", "able", "ible", "ista", "osos",
    "osas", "ico", "ica", "oso", "osa",
]
_ES_VERB_Y = ["yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó"]
_ES_VERB = [
    "aríamos", "eríamos", "iríamos", "iéramos", "iésemos", "aríais", "aremos", "eríais", "eremos", "iríais", "iremos", "ierais", "ieseis", "asteis", "isteis",
    "ábamos", "áramos", "ásemos", "arían", "arías", "aréis", "erían", "erías", "eréis", "irían", "irías", "iréis", "ieran", "iesen", "ieron", "iendo", "ieras",
    "ieses", "abais", "arais", "aseis", "íamos", "arán", "arás", "aría", "erán", "erás", "ería", "irán", "irás", "iría", "iera", "iese", "aste", "iste", "aban",
    "aran", "asen", "aron", "ando", "abas", "adas", "idas", "aras", "ases", "íais", "ados", "idos", "amos", "imos", "emos", "ará", "aré", "erá", "eré", "irá",
    "iré", "aba", "ada", "ida", "ara", "ase", "ían", "ado", "ido", "ías", "áis", "éis", "ía", "ad", "ed", "id", "an", "ió", "ar", "er", "ir", "as", "ís", "en",
    "es",
]


def stem_es(word: str) -> str:
    """The Snowball stem for Spanish."""
    vowels = "aeiouáéíóúü"
    bare = lambda w: w.translate(str.maketrans("áéíóú", "aeiou"))
    r1, r2 = _regions(word, vowels)
    rv = len(word)
    if len(word) > 2:
        if word[1] not in vowels:
            m = re.compile(f"[{vowels}]").search(word, 2)
        elif word[0] in vowels:
            m = re.compile(f"[^{vowels}]").search(word, 2)
        else:
            m = re.match(r"...", word)
        rv = m.end() if m else len(word)
    for p in _ES_PRONOUNS:
        if word.endswith(p):
            head = word[: -len(p)]
            if len(head) >= rv:
                for e in ("iéndo", "ándo", "ár", "ér", "ír"):
                    if head.endswith(e) and len(head) - len(e) >= rv:
                        word = head[: -len(e)] + bare(e)
                        break
                else:
                    for e in ("iendo", "ando", "ar", "er", "ir"):
                        if head.endswith(e) and len(head) - len(e) >= rv:
                            word = head
                            break
                    else:
                        if head.endswith("uyendo") and len(head) - 5 >= rv:
                            word = head
            break
    start = word

    def drop(ending: str, region: int) -> bool:
        nonlocal word
        if word.endswith(ending) and len(word) - len(ending) >= region:
            word = word[: -len(ending)]
            return True
        return False

    endings = [*_ES_PLAIN, "adoras", "adores", "aciones", "adora", "ación", "antes", "ancias", "ancia", "ador", "ante", "logías", "logía", "uciones", "ución", "encias", "encia", "amente", "mente", "idades", "idad", "ivas", "ivos", "iva", "ivo"]
    found = next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)
    if found in _ES_PLAIN:
        drop(found, r2)
    elif found in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
        if drop(found, r2):
            drop("ic", r2)
    elif found in ("logía", "logías"):
        if len(word) - len(found) >= r2:
            word = word[: -len(found)] + "log"
    elif found in ("ución", "uciones"):
        if len(word) - len(found) >= r2:
            word = word[: -len(found)] + "u"
    elif found in ("encia", "encias"):
        if len(word) - len(found) >= r2:
            word = word[: -len(found)] + "ente"
    elif found == "amente":
        if drop(found, r1):
            if drop("iv", r2):
                drop("at", r2)
            else:
                any(drop(e, r2) for e in ("os", "ic", "ad"))
    elif found == "mente":
        if drop(found, r2):
            any(drop(e, r2) for e in ("ante", "able", "ible"))
    elif found in ("idad", "idades"):
        if drop(found, r2):
            any(drop(e, r2) for e in ("abil", "ic", "iv"))
    elif found in ("iva", "ivo", "ivas", "ivos"):
        if drop(found, r2):
            drop("at", r2)
    if word == start:
        e = next((e for e in _ES_VERB_Y if word.endswith(e) and len(word) - len(e) >= rv), None)
        if e and word[: -len(e)].endswith("u"):
            word = word[: -len(e)]
        else:
            e = next((e for e in sorted(_ES_VERB, key=len, reverse=True) if word.endswith(e) and len(word) - len(e) >= rv), None)
            if e:
                word = word[: -len(e)]
                if e in ("en", "es", "éis", "emos") and word.endswith("gu"):
                    word = word[:-1]
    for e in ("os", "a", "o", "á", "í", "ó"):
        if word.endswith(e):
            drop(e, rv)
            break
    else:
        if word.endswith(("e", "é")) and len(word) - 1 >= rv:
            word = word[:-1]
            if word.endswith("gu") and len(word) - 1 >= rv:
                word = word[:-1]
    return bare(word)


# The published Snowball suffix lists for French. Fixed values.
_FR_STANDARD = (
    ("ance iqUe isme able iste eux ances iqUes ismes ables istes", "r2"),
    ("atrice ateur ation atrices ateurs ations", "ic"),
    ("logie logies", "log"),
    ("usion ution usions utions", "u"),
    ("ence ences", "ent"),
    ("ement ements", "ement"),
    ("ité ités", "ité"),
    ("if ive ifs ives", "if"),
    ("eaux", "eau"),
    ("aux", "al"),
    ("euse euses", "eux"),
    ("issement issements", "after consonant"),
    ("amment", "ant"),
    ("emment", "ent1"),
    ("ment ments", "after vowel"),
)
_FR_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez "
    "issiez issions issons it"
).split()
_FR_VERBS = (
    "ions é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
).split()


def stem_fr(word: str) -> str:
    """The Snowball stem for French."""
    vowels = "aeiouyâàëéêèïîôûù"
    v = f"[{vowels}]"
    word = re.sub("([ëï])", lambda m: {"ë": "He", "ï": "Hi"}[m[1]], word)
    word = re.sub(f"(?<={v})([ui])(?={v})", lambda m: m[1].upper(), word)
    word = re.sub(f"(?<={v})y|y(?={v})", "Y", word)
    word = word.replace("qu", "qU")
    r1, r2 = _regions(word, vowels)
    if re.match(f"{v}{{2}}", word) or word.startswith(("par", "col", "tap")):
        rv = min(3, len(word))
    elif re.match("ni[^aeiouy]|ni$", word) and word.startswith("ni"):
        m = re.compile(v).search(word, 1)
        rv = m.end() if m else len(word)
    else:
        m = re.compile(v).search(word, 1)
        rv = m.end() if m else len(word)
    before = word
    endings = sorted(((e, rule) for listed, rule in _FR_STANDARD for e in listed.split()), key=lambda x: -len(x[0]))
    changed, verbs = False, True
    for e, rule in endings:
        if not word.endswith(e):
            continue
        head, at = word[: -len(e)], len(word) - len(e)
        cut = lambda h, suffix: h[: -len(suffix)]
        if rule == "r2" and at >= r2:
            word, changed = head, True
        elif rule == "ic" and at >= r2:
            word, changed = head, True
            if word.endswith("ic"):
                word = cut(word, "ic") if len(word) - 2 >= r2 else cut(word, "ic") + "iqU"
        elif rule == "log" and at >= r2:
            word, changed = head + "log", True
        elif rule == "u" and at >= r2:
            word, changed = head + "u", True
        elif rule == "ent" and at >= r2:
            word, changed = head + "ent", True
        elif rule == "ement" and at >= rv:
            word, changed = head, True
            if word.endswith("iv") and len(word) - 2 >= r2:
                word = cut(word, "iv")
                if word.endswith("at") and len(word) - 2 >= r2:
                    word = cut(word, "at")
            elif word.endswith("eus"):
                if len(word) - 3 >= r2:
                    word = cut(word, "eus")
                elif len(word) - 3 >= r1:
                    word = cut(word, "eus") + "eux"
            elif word.endswith(("abl", "iqU")) and len(word) - 3 >= r2:
                word = word[:-3]
            elif word.endswith(("ièr", "Ièr")) and len(word) - 3 >= rv:
                word = word[:-3] + "i"
        elif rule == "ité" and at >= r2:
            word, changed = head, True
            if word.endswith("abil"):
                word = cut(word, "abil") if len(word) - 4 >= r2 else cut(word, "abil") + "abl"
            elif word.endswith("ic"):
                word = cut(word, "ic") if len(word) - 2 >= r2 else cut(word, "ic") + "iqU"
            elif word.endswith("iv") and len(word) - 2 >= r2:
                word = cut(word, "iv")
        elif rule == "if" and at >= r2:
            word, changed = head, True
            if word.endswith("at") and len(word) - 2 >= r2:
                word = cut(word, "at")
                if word.endswith("ic"):
                    word = cut(word, "ic") if len(word) - 2 >= r2 else cut(word, "ic") + "iqU"
        elif rule == "eau":
            word, changed = head + "eau", True
        elif rule == "al" and at >= r1:
            word, changed = head + "al", True
        elif rule == "eux":
            if at >= r2:
                word, changed = head, True
            elif at >= r1:
                word, changed = head + "eux", True
        elif rule == "after consonant" and at >= r1 and head and head[-1] not in vowels:
            word, changed = head, True
        elif rule == "ant" and at >= rv:
            word, verbs = head + "ant", True
            break
        elif rule == "ent1" and at >= rv:
            word, verbs = head + "ent", True
            break
        elif rule == "after vowel" and len(head) > rv and head[-1] in vowels:
            word, verbs = head, True
            break
        verbs = not changed
        break
    if verbs:
        for e in sorted(_FR_I_VERBS, key=len, reverse=True):
            if word.endswith(e) and len(word) - len(e) >= rv:
                at = len(word) - len(e)
                if at > rv and word[at - 1] not in vowels + "H":
                    word, changed, verbs = word[:at], True, False
                break
    if verbs:
        for e in sorted(_FR_VERBS, key=len, reverse=True):
            if word.endswith(e) and len(word) - len(e) >= rv:
                at = len(word) - len(e)
                if e != "ions" or at >= r2:
                    word, changed = word[:at], True
                    if e[0] in "âa" and word.endswith("e") and len(word) - 1 >= rv:
                        word = word[:-1]
                break
    if changed or word != before:
        if word.endswith("Y"):
            word = word[:-1] + "i"
        elif word.endswith("ç"):
            word = word[:-1] + "c"
    else:
        if word.endswith("s") and len(word) > 1 and (word.endswith("His") or word[-2] not in "aiouès"):
            word = word[:-1]
        for e in ("ière", "Ière", "ion", "ier", "Ier", "e"):
            if word.endswith(e) and len(word) - len(e) >= rv:
                at = len(word) - len(e)
                if e == "ion":
                    if at >= r2 and word[at - 1 : at] in ("s", "t") and at - 1 >= rv:
                        word = word[:at]
                elif e == "e":
                    word = word[:at]
                else:
                    word = word[:at] + "i"
                break
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(f"[éè](?=[^{vowels}]+$)", "e", word)
    return word.replace("He", "ë").replace("Hi", "ï").lower()


@lru_cache(CACHED)
def stem(token: str, lang: str) -> str:
    return {"en": stem_en, "de": stem_de, "es": stem_es, "fr": stem_fr}[lang](token)


@lru_cache(CACHED)
def stem_folded(token: str, lang: str) -> str:
    return fold(stem(token, lang))
