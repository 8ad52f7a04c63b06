"""Repair of text from scanned pages.

A first pass over all chunks counts words and lines. From the frequent words a bounded sample
is corrupted with the usual confusions of character recognition, and an averaged perceptron
learns to undo them: per character it predicts keep, delete, or a replacement (of two
characters where one is to be inserted). The editor proposes corrections for every other word
of the corpus; one stands where its word is far more frequent and where the company the rare
word keeps - texts with other traces of a scan or without - speaks for a misreading. Two more
averaged perceptrons are fitted on a bounded sample of chunks: whether two lines belong
together, and whether a line stands in the place of page furniture. Furniture is told by
place, form and repetition.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import distinct_sample
from lodestone.session import cut, for_workers

# What recognition makes of which characters.
CONFUSIONS = {
    "i": ["!", "l", "1", "j"], "l": ["1", "i", "|", "t"], "s": ["5", "$"], "o": ["0", "c"], "b": ["6", "h"],
    "f": ["ſ", "t"], "t": ["f", "l"], "e": ["c", "o"], "c": ["e", "o"], "a": ["@", "o"], "g": ["q", "9"], "q": ["g"],
    "n": ["ri", "u"], "u": ["n", "ii"], "h": ["li", "b"], "d": ["cl"], "m": ["rn", "nn"], "w": ["vv"],
    "r": ["n"], "z": ["2"], "y": ["v"], "v": ["y"], "k": ["lc"], "in": ["m"], "rn": ["m"], "cl": ["d"], "ri": ["n"],
    "li": ["h"], "nn": ["m"], "vv": ["w"], "B": ["8"], "S": ["5"], "O": ["0"], "I": ["l", "1"], "E": ["F"],
}
#: Words of the training sample, corrupted forms of each, and rounds of training.
SAMPLE_WORDS, FORMS, ROUNDS = 1500, 4, 3
#: A word is frequent from this share of all words on; there are at most 1 / share of them.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-6, 4
#: A correction must be this many times as frequent as the word it replaces; a word with a
#: sign inside that no word has needs less evidence.
FAR_MORE, FAR_MORE_ODD = 30, 3
#: Log odds, before its company is looked at, that a proposal with that evidence is right.
PRIOR = 3.0
#: Repeated lines up to this number may be broadcast.
BROADCAST_LINES = 200_000
#: Lead of the furniture model below which a number's direct neighbours decide.
DOUBT = 5.0
#: Chunks that line joiner and furniture places are learned from, and their greatest length.
SAMPLE_CHUNKS, SAMPLE_LENGTH = 1_000, 6_000
#: Corrections sent to the workers at once; more take further passes.
CORRECTIONS_PER_PASS = 400_000
#: A line's form is furniture of a series when it stands in so many papers.
SERIES_PAPERS = 3

#: Evidence that a line repeated in a paper is a header: two lines in the form of a series
#: title, or three of another form.
WEIGHT, REPEATED = {"series": 3, "maybe": 2, "sure": 3}, 6

_SPLIT = re.compile(r"[\s\-–—/=+<>~…·]+")
_STRIP = ".,;:()[]{}\"'“”‘’«»|?*`_#\\&"
_CUT = re.compile(r"-[ \t]*\n[ \t]*")
_HALF_BEFORE = re.compile(r"[^\W\d_](?:[^\W_]|[!@$|])*$")
_HALF_AFTER = re.compile(r"[^\W\d_][^\s\-]*")
_CUT_END = re.compile(r"[^\W\d_]-[ \t]*$")
_LETTER = re.compile(r"[^\W\d_]")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")


@lru_cache(maxsize=200_000)
def _parts(token: str) -> tuple[str, ...]:
    """The words of a white-space-separated token; compounds follow their parts."""
    if token.isalpha():
        return (token,) if len(token) > 2 else ()
    out = []
    for w in _SPLIT.split(token):
        w = w.strip(_STRIP)
        if w.endswith("!") and not w[:-1].endswith("!"):
            w = w[:-1]
        if len(w) > 2 and _LETTER.search(w):
            out.append(w)
    if "-" in token:
        out += _COMPOUND.findall(token)
    return tuple(out)


def words_of(text: str) -> list[str]:
    """The words of a text, and its hyphenated compounds."""
    return [w for t in text.split() for w in _parts(t)]


def joined_lines(text: str, join: Callable[[str, str], str | None]) -> str:
    """The text with words cut at line ends put together: ``join`` gets the halves around a
    hyphen and gives the word, or None where the line end stays."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        start = max(at, max(text.rfind(c, at, m.start()) for c in " \n\t") + 1)
        a = _HALF_BEFORE.search(text, start, m.start())
        b = _HALF_AFTER.match(text, m.end())
        if a and b and (word := join(a.group(), b.group())) is not None:
            out += [text[at : a.start()], word]
            at = b.end()
    return "".join(out) + text[at:] if out else text


# ---------------------------------------------------------------- averaged perceptron


class Perceptron:
    """An averaged perceptron over string features; the labels allowed depend on a key."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self.labels: dict[str, set[str]] = defaultdict(set)
        self.n = 0

    def scores(self, key: str, features: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels.get(key, ()), 0.0)
        for f in features:
            w = self.weights.get(f)
            if w:
                for label, v in w.items():
                    if label in out:
                        out[label] += v
        return out

    def learn(self, key: str, features: list[str], label: str) -> None:
        self.n += 1
        self.labels[key].add(label)
        scores = self.scores(key, features)
        guess = max(sorted(scores), key=scores.get)
        if guess != label:
            for f in features:
                w = self.weights.setdefault(f, {})
                for k, d in ((label, 1.0), (guess, -1.0)):
                    spot = (f, k)
                    self._sum[spot] += (self.n - self._at[spot]) * w.get(k, 0.0)
                    self._at[spot] = self.n
                    w[k] = w.get(k, 0.0) + d

    def average(self) -> Perceptron:
        for f, w in self.weights.items():
            for k, v in w.items():
                w[k] = (self._sum[f, k] + (self.n - self._at[f, k]) * v) / max(1, self.n)
        self._sum.clear()
        self._at.clear()
        return self


def char_features(word: str, i: int) -> list[str]:
    w = f"^^{word}$$"
    j = i + 2
    c, p, n = w[j], w[j - 1], w[j + 1]
    pp, nn = w[j - 2], w[j + 2]
    return [c, f"p{p}{c}", f"n{c}{n}", f"pn{p}{c}{n}", f"pp{pp}{p}{c}", f"nn{c}{n}{nn}", f"w{pp}{p}{c}{n}{nn}", f"o{p}{n}"]


KEEP, DELETE = "=", "-"


def corrupted(word: str, draw: int) -> tuple[str, list[str]] | None:
    """A corrupted form of the word and the operations, one per character, that undo it."""
    spots = [(i, len(k), k, v) for k, forms in CONFUSIONS.items() for i in range(len(word)) if word.startswith(k, i) for v in forms]
    if not spots:
        return None
    i, n, k, v = sorted(spots)[draw % len(spots)]
    ops = [KEEP] * i + [k] + [DELETE] * (len(v) - 1) + [KEEP] * (len(word) - i - n)
    return word[:i] + v + word[i + n :], ops


def train_editor(frequent: dict[str, int]) -> Perceptron:
    """The character editor, from a sample of at most SAMPLE_WORDS frequent words."""
    chosen = [w for w in frequent if len(w) > 3 and w.isalpha()]
    chosen.sort(key=lambda w: (zlib.crc32(w.encode()), w))
    model = Perceptron()
    examples = []
    for w in chosen[:SAMPLE_WORDS]:
        examples.append((w, [KEEP] * len(w)))
        for d in range(FORMS):
            if made := corrupted(w, zlib.crc32(f"{w}{d}".encode())):
                examples.append(made)
    for _ in range(ROUNDS):
        for form, ops in examples:
            for i, op in enumerate(ops):
                model.learn(form[i], char_features(form, i), op)
    return model.average()


def _frequency(word: str, frequent: dict[str, int]) -> int:
    """Occurrences of a word, a capitalised one also in lower case."""
    return frequent.get(word) or (frequent.get(word.lower(), 0) if word[:1].isupper() else 0)


def corrections_of(word: str, model: Perceptron, frequent: dict[str, int], places: int = 1) -> str | None:
    """The most plausible frequent word that the editor makes of a word by edits in one or two
    places; a replacement and the deletion next to it are one place. All edits are tried."""
    deleted: dict[int, float] = {}
    replaced: list[tuple[float, int, str]] = []
    for i, c in enumerate(word):
        scores = model.scores(c, char_features(word, i))
        base = scores.get(KEEP, 0.0)
        for op, v in scores.items():
            if op == DELETE:
                deleted[i] = v - base
            elif op != KEEP:
                replaced.append((v - base, i, op))
    # One place: from where to where, what stands there, and its score.
    spots = [(i, i + 1, op, v - 2.0) for v, i, op in replaced]
    spots += [(i, i + 2, op, v + deleted[i + 1] - 4.0) for v, i, op in replaced if i + 1 in deleted]
    spots += [(i - 1, i + 1, op, v + deleted[i - 1] - 4.0) for v, i, op in replaced if i - 1 in deleted]
    best, best_score = None, None

    def offer(v: str, score: float) -> None:
        nonlocal best, best_score
        if (best_score is None or (score, v) > (best_score, best)) and v != word and _frequency(v, frequent):
            best, best_score = v, score

    for i, j, op, v in spots:
        offer(word[:i] + op + word[j:], v)
    if places > 1:
        for k, (i, j, op, v) in enumerate(spots):
            for i2, j2, op2, v2 in spots[k + 1 :]:
                if j <= i2:
                    offer(word[:i] + op + word[j:i2] + op2 + word[j2:], v + v2)
                elif j2 <= i:
                    offer(word[:i2] + op2 + word[j2:i] + op + word[j:], v + v2)
    return best


# ---------------------------------------------------------------- page furniture

_PAGE = re.compile(
    r"(?:[~\-–—•*]\s*\d{1,4}\s*[~\-–—•*]|\[?\s*(?:pages?|pg|p)\b\.?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*\]?"
    r"|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}\s*\||\|\s*\d{1,4})",
    re.I,
)
_NUMBER = re.compile(r"[\dlIO](?: ?[\dlIO]){0,3}")
_ROMAN = re.compile(r"[lI]|(?=[ivx]|[ivxlc]{2})(?:c{0,3}(?:x[lc]|l?x{0,3})(?:i[vx]|v?i{0,3})|l{2,3})")
_VALUE = re.compile(r"[\[(]?[-+±]?[\dlO]+(?:[.,][\dlO]+)*(?:\s*[%\w/]{1,7})?[\])]?")
_STRUCTURE = re.compile(r"\s*(?:\||\$|\\|[-*•+]\s|\d+[.)]\s|\d+(?:\.\d+)+\s|#{1,6}\s|```|[ivx]+\)\s)")
_PAGE_BEFORE = re.compile(r"^\s*\d{1,4}(?:\s{2,}|\s*[|·]\s*)(?=\S*[^\W\d])")
_PAGE_AFTER = re.compile(r"(?:\s{2,}|\s*[|·]\s*)\d{1,4}\s*$")


def is_number(line: str) -> bool:
    return _NUMBER.fullmatch(line) is not None or _ROMAN.fullmatch(line) is not None


def is_value(line: str) -> bool:
    return _VALUE.fullmatch(line) is not None and _PAGE.fullmatch(line) is None


def place_features(lines: list[str], i: int) -> list[str]:
    """Where a line stands on its page: at the edge of the text, between blank lines, within a
    sentence that goes on behind it, beside values, list items or table rows, how wide."""
    line = lines[i].strip()
    before = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip()), "")
    after = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip()), "")
    blank_before, blank_after = i > 0 and not lines[i - 1].strip(), i + 1 < len(lines) and not lines[i + 1].strip()
    next_to = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    kind = lambda x: (
        "none" if not x else "value" if is_value(x) else "number" if is_number(x) else "part" if _STRUCTURE.match(x) else
        "open" if x[-1] not in ".!?:" else "closed"
    )
    goes_on = bool(before) and before[-1] not in ".!?:" and after[:1].islower()
    edge = "top" if not before else "bottom" if not after else "inner"
    width = len(line) * 4 // max(1, len(before), len(after)) if before or after else 0
    b, a = kind(before), kind(after)
    return [
        "bias", f"edge {edge}", f"blank {blank_before}{blank_after}", f"on {goes_on}", f"b {b}", f"a {a}", f"ba {b} {a}", f"w {min(width, 4)}",
        f"eb {edge} {blank_before}{blank_after}", f"beside {any(is_value(x) for x in next_to)}", f"low {after[:1].islower()}",
    ]


def train_places(texts: list[str]) -> Perceptron | None:
    """The furniture places, from lines whose form alone tells what they are: page forms and
    sure headers against the values of columns. Numbers that interrupt a sentence, or have
    another value right beside them, are as clear. None where the sample has too few of either."""
    examples: list[tuple[list[str], str]] = []
    for text in texts:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            bare = line.strip()
            if not bare:
                continue
            features = place_features(lines, i)
            if _PAGE.fullmatch(bare) or header_kind(lines, i)[0] == "sure":
                examples.append((features, "furniture"))
            elif is_number(bare):
                if "on True" in features:
                    examples.append((features, "furniture"))
                elif "beside True" in features:
                    examples.append((features, "text"))
            elif is_value(bare):
                examples.append((features, "text"))
    if min(sum(y == k for _, y in examples) for k in ("furniture", "text")) < 20 if examples else True:
        return None
    model = Perceptron()
    for _ in range(ROUNDS):
        for features, y in examples:
            model.learn("line", features, y)
    return model.average()


def is_page_number(lines: list[str], i: int, places: Perceptron | None = None) -> bool:
    """A line that holds nothing but a page number. A bare number is one where it stands in
    the place of furniture or, in doubt, has no other value right beside it."""
    line = lines[i].strip()
    if _PAGE.fullmatch(line):
        return True
    if not is_number(line):
        return False
    features = place_features(lines, i)
    scores = places.scores("line", features) if places else {"furniture": 0.0, "text": 0.0}
    lead = scores["furniture"] - scores["text"]
    return lead > 0 if abs(lead) >= DOUBT else "beside True" not in features


def header_form(line: str) -> tuple[str, bool]:
    """A line without its page number, and whether it had one."""
    bare = _PAGE_AFTER.sub("", _PAGE_BEFORE.sub("", line))
    return bare.strip(), bare.strip() != line.strip()


def header_kind(lines: list[str], i: int) -> tuple[str | None, str]:
    """'sure', 'maybe' (a header if it is repeated) or None for a line, and its bare form."""
    line = lines[i]
    first = line.lstrip()[:1]
    # Lines that go on in lower case make up most texts; no header begins so.
    if not first or first.islower() and " · " not in line or _STRUCTURE.match(line):
        return None, ""
    bare, numbered = header_form(line) if first.isdigit() or line.rstrip()[-1:].isdigit() else (line.strip(), False)
    words = bare.split()
    upper, lower = sum(map(str.isupper, bare)), sum(map(str.islower, bare))
    if not 2 <= len(words) <= 14 or upper + lower < 6 or _VALUE.fullmatch(bare):
        return None, ""
    if upper >= 0.9 * (upper + lower) and upper + lower >= 8:
        return "sure", bare
    if " · " in bare or re.search(r"\bet al\.? \| ", bare):
        return "sure", bare
    if numbered and not re.search(r"[,;:]$", bare) and (words[0][0].isupper() or words[0][0].isdigit()):
        return "sure", bare
    dated = re.search(r"\b(?:19|20)\d\d\.?$", bare) is not None
    closed = bare.endswith(".") and bare[:-1].find(".") > 0
    if bare[0].isupper() and len(words) <= 10 and (closed and len(words) <= 6 or not re.search(r"[.,;:!?]$", bare)):
        return ("series" if dated or closed else "maybe"), bare
    return None, ""


def series_form(bare: str) -> str:
    """A header's form across papers: names and digits masked."""
    return re.sub(r"\d", "9", re.sub(r"\b[A-Z]\w{5,}\b", "N", bare))


def folded(bare: str) -> str:
    return re.sub(r"[\W\d_]+", " ", bare).strip().lower()


# ---------------------------------------------------------------- lines


def line_features(before: str, after: str, widest: int) -> list[str]:
    b, a = before.rstrip(), after.strip()
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else c
    room = len(b) + 1 + len(a.split(" ")[0]) > widest
    return [
        "bias", f"e{kind(b[-1])}", f"s{kind(a[0])}", f"es{kind(b[-1])}{kind(a[0])}", f"r{room}",
        f"rs{room}{kind(a[0])}", f"re{room}{kind(b[-1])}", f"b{bool(_STRUCTURE.match(before))}", f"a{bool(_STRUCTURE.match(after))}",
        f"v{bool(_VALUE.fullmatch(b))}{bool(_VALUE.fullmatch(a))}", f"w{min(4, len(b) * 4 // max(1, widest))}",
    ]


# Lines of lists, tables, values and headings, for samples that have few.
_PARTS = ["- first item: 3 ms", "| name | 4 px | 7 |", "12.5", "(3)", "3.2 Refined map", "$$ a = b $$", "* item", "Total of the column", "281"]


def train_joiner(texts: list[str]) -> Perceptron:
    """Whether two lines belong together, learned from the paragraphs of a sample, wrapped
    again at many widths, from its lines of lists, tables and values, and from the lines that
    hold a word cut at their end."""
    import textwrap

    paragraphs, parts, examples = [], list(_PARTS), []
    for text in texts:
        lines = text.split("\n")
        widest = max(map(len, lines))
        for a, b in zip(lines, lines[1:]):
            if _CUT_END.search(a) and b[:1].islower():
                examples.append((a, b, widest, "join"))
        for block in re.split(r"\n\s*\n", text):
            kept = block.split("\n")
            if len(parts) < 400:
                parts += [x for x in kept if x.strip() and (_STRUCTURE.match(x) or _VALUE.fullmatch(x.strip()))][:4]
            if len(kept) == 1 and len(block) > 200 and not _STRUCTURE.match(block):
                paragraphs.append(block)
    for k, block in enumerate(paragraphs[:200]):
        width = 40 + 7 * (k % 9)
        lines = textwrap.wrap(block[:2_000], width)
        following = paragraphs[(k + 1) % len(paragraphs)][:width].rsplit(" ", 1)[0]
        part, other = parts[k % len(parts)], parts[(k * 7 + 3) % len(parts)]
        examples += [(a, b, width, "join") for a, b in zip(lines, lines[1:])]
        examples += [(lines[-1], part, width, "keep"), (part, other, width, "keep"), (part, lines[0], width, "keep")]
        if len(lines[-1]) + len(following.split(" ")[0]) < width:  # a short last line ends its paragraph
            examples.append((lines[-1], following, width, "keep"))
    # A small base of the same kinds, so that an empty sample leaves no label unknown.
    for a, b, label in (("the method keeps a short", "record of each step", "join"), ("The end.", "- item", "keep"), ("- item", "- other", "keep")):
        examples += [(a, b, 26, label)] * 3
    model = Perceptron()
    for _ in range(4):
        for a, b, width, label in examples:
            if a.strip() and b.strip():
                model.learn("line", line_features(a, b, width), label)
    return model.average()


class PageReader:
    """Applies editor, joiner and furniture rules to chunks."""

    def __init__(self, frequent: dict[str, int], corrections: dict[str, str], places: Perceptron | None = None, joiner: Perceptron | None = None):
        self.frequent, self.fix, self.places = frequent, corrections, places
        self.joiner = joiner or train_joiner([])

    def own_hyphen(self, a: str, b: str) -> bool:
        """Whether the hyphen between two halves is the word's own, by what is frequent."""
        b = b.rstrip(_STRIP + "!")
        whole = self.frequent.get(a + b, self.frequent.get((a + b).lower(), 0))
        hyphened = self.frequent.get(f"{a}-{b}", self.frequent.get(f"{a}-{b}".lower(), 0))
        return hyphened > whole

    def furniture(self, lines: list[str], kinds: list[tuple[str | None, str]], known: set[str]) -> dict[int, str]:
        """Which lines are page numbers and running headers; known: repeated lines, folded."""
        out = {}
        for i, line in enumerate(lines):
            if not line.strip():
                continue
            kind, bare = kinds[i]
            if is_page_number(lines, i, self.places):
                out[i] = "page_number"
            elif kind == "sure" or (kind and known and folded(bare) in known):
                out[i] = "running_header"
        return out

    def unbroken(self, text: str) -> tuple[str, int]:
        """Words cut at line ends made whole; own hyphens keep their hyphen."""
        n = 0

        def join(a: str, b: str) -> str | None:
            nonlocal n
            if not (a[-1].islower() and b[0].islower()):
                return None
            if self.own_hyphen(a, b):
                return f"{a}-{b}"
            n += 1
            return a + b

        return joined_lines(text, join), n

    def noise(self, text: str, known: set[str]) -> tuple[set[str], list[tuple[str | None, str]]]:
        """The sure traces, and what kind of header each line may be."""
        lines = text.split("\n")
        kinds = [header_kind(lines, i) for i in range(len(lines))]
        found = self.furniture(lines, kinds, known)
        out = set(found.values())
        # A line in the form of a series title does not stand between the halves of a word.
        body = "\n".join(x for i, x in enumerate(lines) if i not in found and kinds[i][0] != "series")
        whole, n = self.unbroken(body)
        if n:
            out.add("hyphen_break")
        if not self.fix.keys().isdisjoint(words_of(whole)):
            out.add("misread")
        return out, kinds

    def repaired(self, text: str, known: set[str]) -> str:
        lines = text.split("\n")
        found = self.furniture(lines, [header_kind(lines, i) for i in range(len(lines))], known)
        body, _ = self.unbroken("\n".join(x for i, x in enumerate(lines) if i not in found))
        widest = max((len(x) for i, x in enumerate(lines) if i not in found), default=0)
        lines = body.split("\n")
        out: list[str] = []
        for line in lines:
            if out and out[-1].strip() and line.strip():
                scores = self.joiner.scores("line", line_features(out[-1][-widest - 1 :], line, widest))
                if scores["join"] > scores["keep"]:
                    out[-1] = f"{out[-1].rstrip()} {line.strip()}"
                    continue
            out.append(line.rstrip())
        return re.sub(r"\S+", self._word, "\n".join(out)).strip("\n")

    def _word(self, m: re.Match) -> str:
        token = m.group()
        if not any(w in self.fix for w in words_of(token)):
            return token
        for w in words_of(token):
            if w in self.fix:
                token = token.replace(w, self.fix[w])
        return token


# ---------------------------------------------------------------- passes

_COUNTED = "kind string, a string, b string, c string, n long, clean long"


#: Distinct words that a task counts before it passes them on.
COUNTED_AT_ONCE = 200_000
#: Signs that no word has: what only a misreading puts there.
_ODD = re.compile(r"[!@$|ſ]|\d(?=[^\W\d_])|(?<=[^\W\d_])\d")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, in all and in texts without a trace of a scan; of words with an odd
    sign, in all and in texts without another trace; and the lines that may be headers: per
    paper and per series."""
    words: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    odd = [0, 0]

    def rows_of(keys: list[tuple], counts: list[int], fine: list[int] | None = None) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(counts, pa.int64()), pa.array(fine or [0] * len(counts), pa.int64())], names=["kind", "a", "b", "c", "n", "clean"]
        )

    def counted() -> pa.RecordBatch:
        out = rows_of([("word", w, None, None) for w in words], list(words.values()), [clean[w] for w in words])
        words.clear()
        clean.clear()
        return out

    for batch in batches:
        lines: Counter[tuple] = Counter()
        for paper, chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
            cuts = 0

            def join(a: str, b: str) -> str:
                nonlocal cuts
                cuts += a[-1].islower() and b[0].islower()
                return a + b

            own = words_of(joined_lines(text, join))
            split = text.split("\n")
            mine: Counter[tuple] = Counter()
            traces = cuts
            for i in range(len(split)):
                kind, bare = header_kind(split, i)
                if kind:
                    traces += kind == "sure"
                    mine["line", paper, folded(bare), chunk] += WEIGHT[kind]
                    if kind == "series":
                        mine["series", series_form(bare), paper, ""] = 1
                elif len(split) > 1 and _PAGE.fullmatch(split[i].strip()):
                    traces += 1
            strange = sum(1 for w in own if not w.isalpha() and _ODD.search(w))
            odd[0] += strange
            odd[1] += strange if traces + strange == 1 else 0
            words.update(own)
            if not traces and not strange:
                clean.update(own)
            for k, n in mine.items():
                lines[k] = max(lines[k], n)  # an exact copy of a chunk adds nothing
        yield rows_of(list(lines), list(lines.values()))
        if len(words) > COUNTED_AT_ONCE:
            yield counted()
    yield counted()
    yield rows_of([("odd", None, None, None)], odd[:1], odd[1:])


class ScanModel:
    """What the passes over all chunks found: frequent words, the fitted places and line
    joiner, corrections, repeated lines."""

    def __init__(
        self, frequent: dict[str, int], places: Perceptron | None, joiner: Perceptron, corrections: DataFrame, repeated: DataFrame, series: DataFrame
    ):
        self.frequent, self.places, self.joiner = frequent, places, joiner
        self.corrections, self.repeated, self.series = corrections, repeated, series


def company(n: int, clean: int, ordinary: float, misread: float) -> float:
    """The log likelihood ratio that a word is a misreading: of its ``n`` occurrences ``clean``
    stand in texts without a trace of a scan, as ``ordinary`` of the occurrences of ordinary
    words do, and ``misread`` of those of misreadings."""
    p, q = (min(0.98, max(0.02, x)) for x in (misread, ordinary))
    return clean * math.log(p / q) + (n - clean) * math.log((1 - p) / (1 - q)) if p < q else 0.0


@for_workers
def fit(chunks: DataFrame, paper: Column, chunk: Column, text: Column) -> ScanModel:
    """Counts over all chunks, the trained models, corrections and repeated lines."""
    rows = chunks.select(
        F.lower(F.trim(paper.cast("string"))).alias("paper"), chunk.cast("string").alias("chunk"), text.cast("string").alias("text")
    ).where("text IS NOT NULL")
    sample = distinct_sample(rows.where(F.length("text") <= SAMPLE_LENGTH), F.col("text"), SAMPLE_CHUNKS)
    places, joiner = train_places(sample), train_joiner(sample)
    counted = cut(rows.mapInArrow(_count, _COUNTED))
    words = cut(
        counted.where("kind = 'word'").groupBy("a").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")).withColumnRenamed("a", "word")
    )
    total = words.agg(F.sum("n"), F.sum("clean")).first()
    odd = counted.where("kind = 'odd'").agg(F.sum("n"), F.sum("clean")).first()
    ordinary = (total[1] or 0) / max(1, total[0] or 0)
    misread = (odd[1] or 0) / max(1, odd[0] or 0)
    least = max(FREQUENT_LEAST, int((total[0] or 0) * FREQUENT_SHARE) + 1)
    # At most 1 / FREQUENT_SHARE words reach that share: a bound whatever the corpus.
    frequent = {r["word"]: r["n"] for r in words.where(F.col("n") >= least).toLocalIterator()}
    editor = train_editor(frequent)
    sent = words.sparkSession.sparkContext.broadcast((editor, frequent))
    most = max(frequent.values(), default=0)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for b in batches:
            pairs = []
            for w, n, clean in zip(*(b.column(k).to_pylist() for k in range(3))):
                if v := misread_as(w, n, model, known, company(n, clean, ordinary, misread)):
                    pairs.append((w, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["word", "correct"]
            )

    rare = words.where((F.col("n") * FAR_MORE_ODD <= most) & (F.length("word") > 3))
    corrections = cut(rare.mapInArrow(correct, "word string, correct string"))
    lines = counted.where("kind = 'line'").groupBy("a", "b", "c").agg(F.max("n").alias("n"))
    repeated = lines.groupBy("a", "b").agg(F.sum("n").alias("n")).where((F.col("n") >= REPEATED) & F.col("a").isNotNull()).select(
        F.col("a").alias("paper"), F.col("b").alias("line")
    )
    series = (
        counted.where("kind = 'series'").select("a", "b").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= SERIES_PAPERS).select(F.col("a").alias("form"))
    )
    return ScanModel(frequent, places, joiner, corrections, cut(repeated), cut(series))


def misread_as(word: str, n: int, model: Perceptron, frequent: dict[str, int], company: float = 0.0) -> str | None:
    """The frequent word that a rare word is a misreading of, if any. Capitalised words are
    names as a rule; they count as misread only with a sign that no name has. A word without
    such a sign stays where its company speaks against a misreading: valid rare words stand in
    clean texts as often as others do."""
    odd = bool(_ODD.search(word))
    if len(word) < 4 or (word[0].isupper() and not odd) or (not odd and company + PRIOR <= 0):
        return None
    v = corrections_of(word, model, frequent, places=2 if odd else 1)
    if v is None or not v.isalpha() or _frequency(v, frequent) < (FAR_MORE_ODD if odd else FAR_MORE) * n:
        return None
    return v


def _passes(model: ScanModel) -> Iterator[dict[str, str]]:
    held: dict[str, str] = {}
    for r in model.corrections.toLocalIterator():
        held[r["word"]] = r["correct"]
        if len(held) >= CORRECTIONS_PER_PASS:
            yield held
            held = {}
    yield held


def _series_passes(model: ScanModel) -> Iterator[set[str]]:
    held: set[str] = set()
    for r in model.series.toLocalIterator():
        held.add(r["form"])
        if len(held) >= CORRECTIONS_PER_PASS:
            yield held
            held = set()
    if held:
        yield held


def _without_series(forms: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that takes lines in the form of a series title out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(2).to_pylist():
                lines = (t or "").split("\n")
                kinds = [header_kind(lines, i) for i in range(len(lines))]
                gone = {i for i, (k, bare) in enumerate(kinds) if k == "series" and series_form(bare) in forms}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3)], names=b.schema.names)

    return run


@for_workers
def chunk_noise(chunks: DataFrame, paper: Column, chunk: Column, text: Column, model: ScanModel | None = None) -> DataFrame:
    """paper, chunk, noise: the traces of the printed page in each chunk, one row per kind.

    Kinds: ``hyphen_break``, ``misread``, ``running_header``, ``page_number``. Null and empty
    texts have none. Repeated chunk rows count once, in the result and in what is counted; a
    null paper or chunk id is kept as such. An empty table gives no rows. Other columns play
    no part.
    """
    model = model or fit(chunks, paper, chunk, text)
    kind = chunks.select(chunk.alias("c")).schema["c"].dataType.simpleString()
    rows = chunks.select(
        paper.cast("string").alias("paper"), chunk.alias("chunk"), text.cast("string").alias("text")
    ).where("text IS NOT NULL")
    out = None
    for block in _passes(model):
        sent = rows.sparkSession.sparkContext.broadcast((model.frequent, block, model.places, model.joiner))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            reader = PageReader(*sent.value)
            for b in batches:
                found = []
                for p, c, t in zip(*(x.to_pylist() for x in b.columns)):
                    sure, kinds = reader.noise(t, set())
                    found += [(p, c, k, None, None) for k in sure]
                    for h, bare in kinds:
                        if h in ("maybe", "series"):
                            found.append((p, c, "running_header", folded(bare), series_form(bare) if h == "series" else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], b.schema.field(1).type),
                     *[pa.array([f[i] for f in found], pa.string()) for i in (2, 3, 4)]],
                    names=["paper", "chunk", "noise", "line", "form"],
                )

        part = rows.mapInArrow(scan, f"paper string, chunk {kind}, noise string, line string, form string")
        out = part if out is None else out.unionByName(part)
    seen = cut(out)
    sure = seen.where("line IS NULL").select("paper", "chunk", "noise")
    maybe = seen.where("line IS NOT NULL").withColumn("key", F.lower(F.trim("paper")))
    again = maybe.join(model.repeated.withColumnRenamed("paper", "key"), ["key", "line"], "left_semi")
    serial = maybe.join(model.series, "form", "left_semi")
    cols = ["paper", "chunk", "noise"]
    return sure.unionByName(again.select(*cols)).unionByName(serial.select(*cols)).distinct()


@for_workers
def repaired_chunks(chunks: DataFrame, paper: Column, chunk: Column, text: Column, model: ScanModel | None = None) -> DataFrame:
    """paper, chunk, text: every chunk as continuous readable paragraphs, a row per input row.

    Furniture lines go, cut words are made whole, wrapped lines joined, misread words
    replaced; lists, tables, values, formulas and paragraph breaks stay. Null stays null.
    """
    model = model or fit(chunks, paper, chunk, text)
    kind = chunks.select(chunk.alias("c")).schema["c"].dataType.simpleString()
    known = model.repeated.groupBy("paper").agg(F.collect_set("line").alias("known")).withColumnRenamed("paper", "key")
    rows = chunks.select(paper.cast("string").alias("paper"), chunk.alias("chunk"), text.cast("string").alias("text"))
    # Few repeated lines go to the texts; many are joined by shuffle.
    few = model.repeated.count() <= BROADCAST_LINES
    rows = rows.withColumn("key", F.lower(F.trim("paper"))).join(F.broadcast(known) if few else known, "key", "left").select("paper", "chunk", "text", "known")
    schema = f"paper string, chunk {kind}, text string, known array<string>"
    for forms in _series_passes(model):
        rows = rows.mapInArrow(_without_series(forms), schema)
    for block in _passes(model):
        sent = rows.sparkSession.sparkContext.broadcast((model.frequent, block, model.places, model.joiner))

        def repair(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            reader = PageReader(*sent.value)
            for b in batches:
                texts = [
                    None if t is None else reader.repaired(t, set(k or ()))
                    for t, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3)], names=b.schema.names)

        rows = rows.mapInArrow(repair, schema)
    return rows.select("paper", "chunk", "text")
