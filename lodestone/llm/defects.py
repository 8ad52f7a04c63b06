"""Broken question-answer pairs: empty, copied, refused, foreign and truncated answers.

A pushdown parser follows fences, code spans, formulas, brackets, quotations, emphasis, tags
and list items to the end of an answer; greedy string tiling over hashed runs finds copies of
the question; a refusal grammar and checks of script and language (character n-grams) do the
rest. Whether a last sentence without a final mark is complete is judged by an averaged
perceptron that has learned from finished sentences of a bounded sample of the answers and
from their beginnings; whether a last word was cut in two shows in the words of all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import languages
from lodestone.llm.sampling import distinct_sample
from lodestone.llm.sentences import SentenceModel, is_beginning, train
from lodestone.session import cut, for_workers

# Stand-ins for an answer, without case, spaces, brackets and final stops.
STAND_INS = {
    "", "-", "--", "—", "–", "?", "??", "???", "...", "…", ".", "*", "/", "_", "n/a", "na", "n.a", "none", "null", "nil",
    "nan", "nothing", "tbd", "tba", "todo", "unknown", "undefined", "empty", "blank", "missing", "no answer",
    "no answer given", "no answer provided", "no response", "not available", "not applicable", "to be determined",
    "to be added", "to be done", "placeholder", "answer", "xxx", "keine antwort", "k.a", "sin respuesta",
    "pas de réponse", "aucune réponse", "keine", "ninguna", "aucun", "aucune", "sans réponse", "s/o",
}

# Words after which no sentence of these languages ends.
NEVER_LAST = set(
    "the a an of and or to in is are was were be been with by from at for on as that than then which who whose where "
    "when while whereas although because until once if so but nor its their our his her this these those each every "
    "any some such via per into onto upon about between through during despite across without within beyond near "
    "der die das den dem des ein eine einen einem einer eines und oder mit von zu für im am zum zur weil dass wenn "
    "obwohl während als bei durch über unter nach vor aus "
    "le les du des un une et ou de dans pour par avec sur que qui dont lorsque puisque car sous sans chez "
    "el los las una y o del para por con sobre que cuando porque aunque sin desde hasta entre tras su sus".split()
)
# What may stand before a copied question.
LEAD_INS = set("q question you asked ask the is was your my a answer here frage pregunta la die sie fragten".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’_-][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+")
# Abbreviations that do not end an answer.
_ABBREVIATION = re.compile(r"\b(?:i\.e|e\.g|cf|vs|approx|resp|incl|viz|fig|figs|eq|sec|tab|z\.b|d\.h|p\.ej|bzw|p\.ex)\.$")
_LAST = re.compile(r"([^\W\d_]+(?:['’_-][^\W_]+)*)$")

_CANNOT = (
    r"(?:can(?:no|')?t|can not|could not|couldn't|am (?:unable|not able)|'m (?:unable|not able)|must (?:decline|refuse)"
    r"|have to (?:decline|refuse)|won't|will not|do(?: not|n't) (?:have|know|see)|decline|refuse|prefer not)"
)
_OPENER = (
    r"(?:(?:i'm|i am|we are)? ?(?:very |so )?sorry|sorry|i apologi[sz]e|apologies|my apologies|unfortunately|regrettably"
    r"|note|as an? (?:ai|assistant|language model|ai language model)(?: model)?|being an? (?:ai|assistant|(?:large )?language model)"
    r"|however|i'm afraid|i am afraid)[,;:.! ]*(?:but |that |and )?"
)
REFUSAL = re.compile(
    rf"^(?:{_OPENER}){{0,3}}(?:"
    rf"i {_CANNOT}\b|i'm (?:unable|not able)\b|we {_CANNOT} (?:answer|help|say|tell|provide)\b"
    r"|(?:it is|it's) (?:impossible|not possible) for me\b"
    r"|there (?:is|are)(?: not|n't) enough (?:context|information|detail|details)\b.{0,40}\b(?:respond|answer|say|tell|for me)\b"
    r"|there is (?:insufficient|no) (?:context|information)\b.{0,30}\b(?:respond|answer|say)\b"
    r"|(?:the|this) (?:passage|text|excerpt|chunk|context|document|paper) does(?: not|n't) (?:provide|contain|give|have|include) "
    r"(?:enough|sufficient|any|the) (?:information|context|detail|details)\b.{0,30}\banswer\b"
    r"|(?:the|this|that) (?:requested )?(?:detail|details|information|answer|request|question) (?:is|are) (?:not something|beyond what|outside what) (?:i|we) can\b"
    r"|no answer (?:can|could) be (?:given|provided)\b|(?:this|the) question (?:cannot|can't|can not) be answered\b"
    r"|ich kann (?:diese|die|das|dazu|leider|hier)?\b.{0,40}\bnicht\b|leider kann ich\b|tut mir leid"
    r"|je ne (?:peux|puis|suis) pas\b|désolé|no puedo\b|lo siento"
    r")",
    re.S,
)


def bare(s: str) -> str:
    return " ".join(s.split()).strip("[](){}<>\"'`*").strip().rstrip(".!").strip().lower()


def is_empty(answer: str) -> bool:
    if not any(map(str.isalnum, answer)):
        return True
    # The longest stand-in has fewer than 30 characters.
    return len(text := bare(answer)) < 30 and text in STAND_INS


def _runs(tokens: list[int], size: int) -> list[int]:
    """A rolling hash of every run of ``size`` tokens."""
    modulus, base = (1 << 61) - 1, 1_000_003
    top = pow(base, size - 1, modulus)
    out, h = [], 0
    for k, t in enumerate(tokens):
        if k >= size:
            h = (h - tokens[k - size] * top) % modulus
        h = (h * base + t) % modulus
        if k >= size - 1:
            out.append(h)
    return out


def tiles(question: list[str], answer: list[str], least: int = 2) -> tuple[int, list[bool]]:
    """Greedy string tiling: how many tokens of the question lie in tiles, and which of the
    answer's tokens do. Long runs come first: runs of a power of two of tokens are found by
    their hashes, then grown; no token on either side lies in two tiles. Each size takes time
    in proportion to both lengths, so the whole takes n log n."""
    number = {t: i + 1 for i, t in enumerate(dict.fromkeys([*question, *answer]))}
    q, a = [number[t] for t in question], [number[t] for t in answer]
    held_q, held_a = [False] * len(q), [False] * len(a)
    size = 1 << max(0, min(len(q), len(a)).bit_length() - 1)
    while size >= least:
        where: dict[int, list[int]] = {}
        hashes = _runs(q, size)
        for i in range(len(hashes) - 1, -1, -1):
            where.setdefault(hashes[i], []).append(i)
        j, of_answer = 0, _runs(a, size)
        while j < len(of_answer):
            # Tiles are at least ``size`` long, so one that meets a run covers one of its ends.
            if held_a[j] or held_a[j + size - 1]:
                j += 1
                continue
            places = where.get(of_answer[j], [])
            while places and (held_q[places[-1]] or held_q[places[-1] + size - 1]):
                places.pop()
            if not places or q[places[-1] : places[-1] + size] != a[j : j + size]:
                j += 1
                continue
            i, n = places.pop(), size
            while i + n < len(q) and j + n < len(a) and not held_q[i + n] and not held_a[j + n] and q[i + n] == a[j + n]:
                n += 1
            held_q[i : i + n] = [True] * n
            held_a[j : j + n] = [True] * n
            j += n
        size >>= 1
    return sum(held_q), held_a


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question, perhaps announced, perhaps several times over: the answer is
    tiled with as many copies of the question as its length asks for."""
    q, a = _TOKEN.findall(question.lower()), _TOKEN.findall(answer.lower())
    if len(q) < 3 or len(a) < 0.8 * len(q):
        return False
    if q == a:
        return True
    known = set(q)
    if sum(t in known for t in a) < 0.75 * len(a):
        return False
    times = max(1, round(len(a) / len(q)))
    covered, held = tiles(q * times, a)
    rest = [t for t, h in zip(a, held) if not h]
    return covered >= 0.85 * len(q) * times and len(rest) <= 4 * times and all(t in LEAD_INS for t in rest)


def is_refusal(answer: str) -> bool:
    text = " ".join(answer.split()).lower().replace("’", "'").lstrip("\"'*([ ")
    return bool(REFUSAL.match(text))


# Tags that are closed by a tag of their own.
_TAGS = "b|i|u|em|strong|code|pre|sub|sup|p|ul|ol|li|table|tr|td|th|span|div|a|h[1-6]|blockquote|math"
_MARKER = r"[ \t]*(?:[-*•+]|\(?\d{1,3}[.)])"
_MARKS = re.compile(
    rf"(?P<tag></?(?:{_TAGS})\b[^<>\n]*>)|(?P<broken></?(?:{_TAGS})\b[^<>\n]*\Z)|(?P<item>(?m:^{_MARKER})(?:[ \t]+|\Z))"
    r"|\\(?:begin|end)\{[a-z]+\*?\}|```|`|\$\$|\$|\*\*|[()\[\]{}\"“”«»\n]"
)
_PARTNER = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def open_structures(text: str) -> list[str]:
    """What is still open at the end of the text, by a pushdown parser over fences, code
    spans, formulas, brackets, quotations, emphasis, tags, environments and list items (an
    item is open while nothing follows its marker). Closers without a partner (list marks such
    as ``1)``, stray quotes, prices) are passed over; inside code and formulas nothing but
    their end counts."""
    stack: list[str] = []

    def close(opener: str) -> None:
        if opener in stack:
            while stack.pop() != opener:
                pass

    for m in _MARKS.finditer(text):
        mark = m.group()
        before = text[m.start() - 1] if m.start() else " "
        after = text[m.end()] if m.end() < len(text) else " "
        inside = stack[-1] if stack and stack[-1] in ("```", "`", "$$", "$") else None
        if inside:
            if mark == inside:
                stack.pop()
            continue
        if stack and stack[-1] == "item" and text[m.start() - 1 : m.start()].strip():
            stack.pop()  # something stands behind the marker
        if m.lastgroup == "item":
            close("item")
            stack.append("item")
        elif m.lastgroup == "broken":
            stack.append(mark)
        elif m.lastgroup == "tag":
            name = re.match(r"</?(\w+)", mark).group(1)
            if mark[1] == "/":
                close(f"<{name}>")
            elif not mark.endswith("/>"):
                stack.append(f"<{name}>")
        elif mark.startswith("\\begin"):
            stack.append(mark[6:])
        elif mark.startswith("\\end"):
            close(mark[4:])
        elif mark in ("```", "`", "$$"):
            stack.append(mark)
        elif mark == "$":  # a formula, not a price
            if (before.isspace() or before in "([") and (after.isalpha() or after == "\\"):
                stack.append("$")
        elif mark == "**":
            if "**" in stack:
                close("**")
            elif not after.isspace() and (before.isspace() or not before.isalnum()):
                stack.append("**")
        elif mark == '"':
            if '"' in stack and not (before.isspace() and not after.isspace()):
                close('"')
            elif (before.isspace() or before in "([{“«") and not after.isspace():
                stack.append('"')
        elif mark in _PARTNER:
            close(_PARTNER[mark])
        elif mark != "\n":
            stack.append(mark)
    if stack and stack[-1] == "item" and re.sub(rf"\A{_MARKER}", "", text.rsplit("\n", 1)[-1]).strip():
        stack.pop()
    return stack


_LIST_END = re.compile(r"(?:^|[\s,;:])(?:\(?\d{1,2}[.)]|[a-z]\)|[-*•])\s*$")
_LIST_BEGUN = re.compile(r"[,;:]\s*\(?(?:\d{1,2}[.)]|[a-z]\))$|\n\s*(?:\d{1,2}[.)]|[-*•])$")
_FINAL = re.compile(r"[.!?。！？][\"'”’»)\]]*$")


def ending(answer: str, question: str = "", model: SentenceModel | None = None) -> tuple[str, str | None]:
    """('cut', None), ('sound', None), or ('open', last word) where it depends on the words of
    all texts whether the last word is whole."""
    text = answer.rstrip()
    stack = open_structures(text)
    dots = 3 if text.endswith("...") else text.endswith("…")
    # What ends a text shows in its last word and a little before it.
    tail = text[-40:]
    final = _FINAL.search(tail) is not None
    if any(s != '"' for s in stack):
        return "cut", None
    if stack and not final:
        return "cut", None
    if _ABBREVIATION.search(tail.lower()):
        return "cut", None
    if not dots and final and not _LIST_END.search(tail):
        return "sound", None
    body = text[: len(text) - dots].rstrip() if dots else text
    if body and body[-1] in ",;:-–—&+=/([{":
        return "cut", None
    if _LIST_END.search(body[-40:]) and re.search(r"\w.*\w", body, re.S):
        return ("cut", None) if _LIST_BEGUN.search(body[-60:]) else ("sound", None)
    if body and body[-1] in ")]}":  # a reference or remark that is closed stands behind what it belongs to
        return "sound", None
    if model and not dots and is_beginning(body, model):
        return "cut", None
    token = body.rsplit(None, 1)[-1] if body.strip() else ""
    last = _LAST.search(token)
    if not last:
        return "sound", None
    word = last.group(1).lower()
    ahead = body[: len(body) - len(last.group(1))]
    if word in NEVER_LAST and _WORD.search(ahead):
        return "cut", None
    if dots:  # trailing off is no cut word
        return "sound", None
    around = set(_WORD.findall(f"{question} {ahead}".lower()))
    if word in around:
        return "sound", None
    if len(word) > 1 and any(w.startswith(word) for w in around):
        return "cut", None
    return "open", word


def judge(question: str, answer: str, model: SentenceModel | None = None) -> tuple[str | None, str | None]:
    """The defect of a pair, or the last word on which it depends whether it is truncated."""
    if is_empty(answer):
        return "empty", None
    if is_copy(question, answer):
        return "copied_question", None
    if is_refusal(answer):
        return "refusal", None
    if languages.differs(question, answer):
        return "other_language", None
    end, word = ending(answer, question, model)
    return ("truncated", None) if end == "cut" else (None, word)


_ROWS = "id string, defect string, word string, seen long"
#: A last word that no other record has is cut if words of this many records begin with it.
FREQUENT = 5
#: Distinct words that a task counts before it passes them on.
COUNTED_AT_ONCE = 200_000
#: Finished answers whose sentences the sentence model is fitted on, and their greatest length.
SAMPLE_ANSWERS, SAMPLE_LENGTH = 4_000, 2_000


def fitted_sentences(rows: DataFrame, answer: str, sample: int = SAMPLE_ANSWERS) -> SentenceModel | None:
    """The sentence model, from the ``sample`` distinct answers with a final mark whose hashes
    are least: a random sample that is the same whatever the order and number of copies."""
    ends = F.trim(F.col(answer)).rlike(r"[.!?]$")
    chosen = rows.where(ends & (F.length(answer) <= SAMPLE_LENGTH))
    return train(distinct_sample(chosen, F.col(answer), sample))


@for_workers
def pair_defects(pairs: DataFrame, record_id: Column, question: Column, answer: Column) -> DataFrame:
    """id, defect: the records with a defective answer, one defect each, each once.

    Defects, the first that holds: ``empty`` (null, blank or a stand-in), ``copied_question``
    (nothing but the question, perhaps repeated or announced), ``refusal``,
    ``other_language`` (another script or language than the question's), ``truncated``. Null
    questions count as empty text. Null ids are left out; ids come out as strings. An empty
    table gives no rows. Other columns play no part.

    What an answer shows by itself is judged by itself. Two things are learned from the table:
    the sentence model, from a bounded sample (without enough finished sentences there is none,
    and nothing is called truncated on its account), and the words of all records, against
    which a last word that stands nowhere else is held.
    """
    rows = pairs.select(
        record_id.cast("string").alias("id"),
        F.coalesce(question.cast("string"), F.lit("")).alias("q"),
        F.coalesce(answer.cast("string"), F.lit("")).alias("a"),
    ).where("id IS NOT NULL")
    sent = rows.sparkSession.sparkContext.broadcast(fitted_sentences(rows, "a"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen: Counter[str] = Counter()

        def rows_of(ids: list, defects: list, words: list, counts: list) -> pa.RecordBatch:
            cols = zip((ids, defects, words, counts), (pa.string(),) * 3 + (pa.int64(),))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["id", "defect", "word", "seen"])

        def counted() -> pa.RecordBatch:
            none = [None] * len(seen)
            out = rows_of(none, none, list(seen), list(seen.values()))
            seen.clear()
            return out

        for b in batches:
            ids, defects, words = [], [], []
            for i, q, a in zip(*(c.to_pylist() for c in b.columns)):
                defect, word = judge(q, a, model)
                if defect or word:
                    ids.append(i)
                    defects.append(defect)
                    words.append(word)
                text = a.lower()
                if word:  # the word in question is no evidence about itself
                    text = text[: text.rindex(word)]
                elif defect == "truncated":
                    text = text.rstrip(" .…")
                    text = text[: len(text) - len(text.split(" ")[-1])]
                # A word counts once per record.
                seen.update(set(_WORD.findall(f"{q.lower()} {text}")))
            yield rows_of(ids, defects, words, [0] * len(ids))
            if len(seen) > COUNTED_AT_ONCE:
                yield counted()
        yield counted()

    found = cut(rows.mapInArrow(scan, _ROWS))
    sure = found.where("id IS NOT NULL AND defect IS NOT NULL").select("id", "defect")
    unsure = found.where("id IS NOT NULL AND defect IS NULL").select("id", "word")
    known = found.where("id IS NULL").groupBy("word").agg(F.sum("seen").alias("seen"))
    # A last word that occurs nowhere else and begins a frequent one has been cut in two.
    unknown = cut(unsure.select("word").distinct().join(known, "word", "left_anti"))
    parts = known.where((F.col("seen") >= FREQUENT) & (F.length("word") > 2)).select(
        F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 1), lambda n: F.left(F.col("word"), n))).alias("word")
    )
    begun = unknown.join(parts, "word", "left_semi")
    truncated = unsure.join(begun, "word", "left_semi").select("id", F.lit("truncated").alias("defect"))
    # Repeated rows of an id may differ; the least defect name stands for the record.
    return sure.unionByName(truncated).groupBy("id").agg(F.min("defect").alias("defect"))
