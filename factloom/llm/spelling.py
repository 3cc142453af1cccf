"""Names typed by people, taken apart, and compared in spite of how they were typed."""

from __future__ import annotations

import re
import unicodedata

#: Letters that do not decompose, and digits read for letters.
_LETTERS = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "0": "o", "1": "l", "5": "s"})
_UMLAUT = re.compile(r"(?<=[aou])e")
_TITLES = frozenset("dr prof professor mr mrs ms miss sir md phd jr sr herr frau".split())
_PARTICLES = frozenset("von van de la der den del di da du le el zu o y".split())
#: Familiar forms of given names that are no beginning of them, and words that name the kind of a body: the default of ``Lists``.
NICKNAMES = {
    "abby": "abigail", "lili": "aurelie elizabeth", "toni": "antoinette", "tony": "anthony antoinette", "bill": "william", "billy": "william", "will": "william", "bob": "robert", "bobby": "robert",
    "rob": "robert", "charo": "rosario", "concha": "concepcion", "conchita": "concepcion", "dick": "richard", "rick": "richard", "rich": "richard", "ed": "edward", "ted": "edward theodore",
    "teddy": "theodore edward", "fine": "josefine", "josi": "josefine", "fran": "francisco", "paco": "francisco", "pancho": "francisco", "fritz": "friedrich", "ginette": "genevieve", "ginny": "genevieve virginia",
    "hans": "johannes", "hannes": "johannes", "kit": "christopher", "chris": "christopher", "kathy": "katherine", "kate": "katherine", "katie": "katherine", "larry": "lawrence", "lola": "dolores",
    "luke": "lukasz", "lupe": "guadalupe", "lupita": "guadalupe", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "nacho": "ignacio", "nate": "nathaniel", "nat": "nathaniel", "nelly": "eleanor cornelia",
    "nell": "eleanor", "ellie": "eleanor", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "pepe": "jose", "poldi": "leopold", "leo": "leopold", "basti": "sebastian", "sepp": "josef", "sue": "susanna", "susi": "susanna",
    "thea": "dorothea", "dora": "dorothea", "dot": "dorothea", "tilda": "mathilde", "tilly": "mathilde", "tori": "victoria", "vicky": "victoria", "uschi": "ursula", "ulla": "ursula", "zoli": "zoltan", "son": "soren", "jo": "johannes josefine josef", "sasha": "alexander", "gunni": "gunther", "theo": "theodore",
    "sandy": "alexander", "sascha": "alexander", "liz": "elizabeth", "lisa": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "gabi": "gabriele", "jurg": "jurgen", "sam": "samuel", "tom": "thomas", "tommy": "thomas",
    "fred": "frederick friedrich", "freddy": "frederick", "bart": "bartholomew", "ben": "benjamin", "phil": "philippe", "neli": "cornelia", "nele": "cornelia", "nelia": "cornelia", "corrie": "cornelia", "jim": "james", "jack": "john", "joe": "joseph jose",
}
KINDS = {
    "institute": "institute institut inst", "centre": "centre center ctr cent", "foundation": "foundation found fdn fndn", "laboratory": "laboratory laboratories lab labs", "department": "department dept dep dpt",
    "society": "society soc", "academy": "academy acad", "hospital": "hospital hosp", "university": "university univ uni", "clinic": "clinic clin", "college": "college coll", "school": "school sch", "association": "association assoc assn",
}
_LEGAL = frozenset("ltd gmbh inc llc ag plc co corp ev sa".split())
#: Longer words are cut into pieces for their keys, as they have too many forms that lack two letters.
LONG = 30


class Lists:
    """The word lists that names are read with; an installation brings its own for its languages."""

    def __init__(self, nicknames: dict[str, str] | None = None, kinds: dict[str, str] | None = None):
        self.nicknames = {k: tuple(v.split()) for k, v in (NICKNAMES if nicknames is None else nicknames).items()}
        self.kinds = KINDS if kinds is None else kinds
        self.kind_of = {w: k for k, ws in self.kinds.items() for w in ws.split()}

    def of(self, given: str) -> tuple[str, ...]:
        return self.nicknames.get(given, ())


LISTS = Lists()
_CONNECT = frozenset(("for", "of", "f", "-", "fur", "de", "pour", "–"))


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).lower().translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


def squashed(word: str) -> str:
    """With transliterated umlauts as the plain vowel."""
    return _UMLAUT.sub("", word)


def plain(s: str) -> str:
    return re.sub(r"[^a-z]", "", fold(s))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, or most + 1 when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def close(a: str, b: str) -> bool:
    """Whether two words are one but for a typing error, or two in a long word."""
    most = edits(min(a, b, key=len))
    return distance(a, b, most) <= most or (("e" in a or "e" in b) and distance(squashed(a), squashed(b), most) <= most)


def person(name: str) -> str | None:
    """``surname|given names`` of a person's name, or null."""
    name = re.sub(r"\([^)]*\)", " ", name or "")
    name = re.sub(r"(?i)\bo\s*['’]\s*(?=\w)", "", name)
    split = lambda x: [t for t in re.split(r"[\s.\-‐–]+", fold(x).replace("'", "").replace("’", "")) if re.search("[a-z]", t)]
    keep = lambda ts: [p for t in ts if t not in _TITLES and t not in _PARTICLES and (p := plain(t))]
    if "," in name:
        last, _, first = name.partition(",")
        sur, given = keep(split(last)), [plain(t) for t in split(first) if t not in _TITLES and not (t in _PARTICLES and t not in ("o", "y"))]
    else:
        tokens = [t for t in split(name) if t not in _TITLES]
        k = len(tokens)
        while k > 1 and len(tokens[k - 1]) == 1:
            k -= 1
        if 0 < k < len(tokens):
            sur, given = keep(tokens[:k])[-1:], [plain(t) for t in tokens[k:]] if k == 1 or all(t in _PARTICLES for t in tokens[: k - 1]) else keep(tokens[: k - 1])
        else:
            sur, given = keep(tokens[-1:]), [plain(t) for i, t in enumerate(tokens[:-1]) if t not in _PARTICLES or (len(t) == 1 and i < len(tokens) - 1)]
    given = [g for g in given if g]
    surname = re.sub(r"^ma?c(?=.{5})", "", "".join(sur))
    return f"{surname}|{' '.join(given)}" if len(surname) > 1 and given else None


def _alike(a: str, b: str) -> bool:
    if a == b or close(a, b) or (max(len(a), len(b)) > 3 and min(len(a), len(b)) > 2 and distance(a, b, 1) <= 1):
        return True
    return (len(a) >= 3 and b.startswith(a)) or (len(b) >= 3 and a.startswith(b))


def same_given(a: str, b: str, lists: Lists = LISTS) -> bool:
    """Two full given names: equal, mistyped, the beginning of one another, or familiar forms of one name."""
    return any(_alike(x, y) for x in (a, *lists.of(a)) for y in (b, *lists.of(b)))


def fits(a: str, b: str, lists: Lists = LISTS) -> bool:
    """Two first given names, of which either may be an initial."""
    if len(a) > 1 and len(b) > 1:
        return same_given(a, b, lists)
    full, initial = (a, b) if len(a) > 1 else (b, a)
    return full[0] == initial[0] or any(n[0] == initial[0] for n in lists.of(full))


def same_person(f: str, g: str, lists: Lists = LISTS) -> int:
    """2: one person; 1: may be, as one side has only an initial; 0: not by these spellings; -1: no."""
    if f == g:
        return 2
    (s, a), (t, b) = ((x.partition("|")[0], x.partition("|")[2].split()) for x in (f, g))
    if not close(s, t):
        return 0
    if not fits(a[0], b[0], lists):
        return -1
    if len(a) > 1 and len(b) > 1:
        x, y = a[1], b[1]
        if x[0] != y[0] if min(len(x), len(y)) == 1 else not same_given(x, y, lists):
            return -1
    return 2 if len(a[0]) > 1 and len(b[0]) > 1 else 1


def kind_of(token: str, lists: Lists = LISTS) -> str | None:
    if token in lists.kind_of:
        return lists.kind_of[token]
    if len(token) >= 6:
        for k in lists.kinds:
            if distance(token, k, 1) <= 1:
                return k
    return None


def body(name: str, lists: Lists = LISTS) -> str | None:
    """``house|kind|field words|acronym`` of an organisation's name, or null where no kind of body is named."""
    text = fold(name or "")
    acronym = "".join(re.findall(r"\(\s*([a-z]{2,8})\s*\)\s*$", text))
    text = re.sub(r"\be\.\s*v\.", " ", re.sub(r"\([^)]*\)", " ", text))
    parts = [[t for t in re.findall(r"[a-z]+|(?<=\s)[-–](?=\s)", p) if t not in _LEGAL and t != "the"] for p in text.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return None
    tokens = parts[0]
    at = next((i for i, t in enumerate(tokens) if kind_of(t, lists)), None)
    if at is None:
        return None
    kinds = [kind_of(tokens[at], lists)]
    end = at + 1
    while end < len(tokens) and kind_of(tokens[end], lists):
        kinds.append(kind_of(tokens[end], lists))
        end += 1
    kind = "hospital" if "hospital" in kinds else kinds[0]
    before, after = tokens[:at], tokens[end:]
    if not before:
        house = "".join(parts[-1]) if len(parts) > 1 else ""
        field = after[1:] if after and after[0] in _CONNECT else after
    elif not after:
        house, field = before[0], before[1:]
    elif after[0] in _CONNECT:
        house, field = "".join(before), after[1:]
    else:
        house, field = "".join(after), before
    field = [t for t in field if t not in _CONNECT and t not in ("and", "und")]
    house = plain(house)
    return f"{house}|{kind}|{' '.join(field)}|{acronym}" if len(house) > 2 else None


def _same_word(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    return a == b or close(a, b) or (len(a) >= 3 and b.startswith(a)) or (len(a) >= 3 and any(distance(a, b[:k], 1) <= 1 for k in (len(a), len(a) + 1) if len(a) > 4))


def same_body(f: str, g: str) -> int:
    """2: one body; 0: not by these spellings; -1: another body of a house of that name."""
    (h, k, x, p), (i, m, y, q) = f.split("|"), g.split("|")
    if not close(h, i):
        return 0
    if k != m:
        return -1
    a, b = x.split(), y.split()
    if a and b:
        return 2 if len(a) == len(b) and all(map(_same_word, a, b)) else -1
    if p and q:
        return 2 if p == q else -1
    letters, words = (p, b) if p else (q, a)
    if letters and words:
        return 2 if letters[1:] in {kk + "".join(w[0] for w in words) for kk in ((k[0], "uh") if k == "hospital" else (k[0],))} else -1
    return 0


def edits(word: str) -> int:
    """How many typing errors a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def _deletions(word: str, most: int) -> set[str]:
    """The word and all forms that lack up to ``most`` letters."""
    out = new = {word}
    for _ in range(most):
        new = {x[:i] + x[i + 1 :] for x in new for i in range(len(x))}
        out = out | new
    return out


def _pieces(word: str) -> set[str]:
    """For long words: fifths of a word of about this length, wherever two edits may have moved them.

    Two edits, swaps over a border included, touch four of five pieces at most.
    """
    out = set()
    for n in range(len(word) - 2, len(word) + 3):
        cuts = [n * i // 5 for i in range(6)]
        out.update(f"{n}.{i}.{word[max(0, lo + s) : hi + s]}" for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) for s in range(-2, 3))
    return out


def keys(word: str) -> list[str]:
    """Keys of a word: any two that are ``close`` share one."""
    most, out = edits(word), set()
    for form in {word, squashed(word)}:
        if len(form) <= LONG:
            out |= _deletions(form, most)
        if len(form) > LONG - 2:
            out |= _pieces(form)
    return list(out)


def given_keys(name: str, lists: Lists = LISTS) -> tuple[list[str], list[str]]:
    """(own, all) keys of a full given name: where two ``same_given`` names meet, an own key of one is among all keys of the other.

    All keys hold the beginnings, so that a name meets those that it begins.
    """
    own, every = set(), set()
    for x in (name, *lists.of(name)):
        near = set(keys(x)) | (_deletions(x, 1) if 2 < len(x) <= LONG else set())
        begin = [f"^{x[:k]}" for k in range(3, min(len(x), LONG) + 1)] + [f"^{x[:LONG]}+"] * (len(x) > LONG)
        own |= near | {f"^{x}" if len(x) <= LONG else begin[-1]}
        every |= near | set(begin)
    return list(own), list(every)


def initials(name: str, lists: Lists = LISTS) -> list[str]:
    """The initials that a given name is written with."""
    return sorted({x[0] for x in (name, *lists.of(name))})
