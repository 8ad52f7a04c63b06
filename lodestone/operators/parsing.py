"""Model answers, reference lists, page blocks and source code as rows."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import for_workers

# ---------------------------------------------------------------- model answers

_DECODER = json.JSONDecoder()


def json_objects(text: str) -> list[dict] | None:
    """The objects of a model's JSON answer: an array, an object with a list under
    ``nuggets``, or as many whole objects as a broken-off array still holds. Code fences and
    words around the JSON are passed over. None where no JSON is found."""
    at = re.search(r"[\[{]", text)
    while at:
        start = at.start()
        try:
            value, _ = _DECODER.raw_decode(text, start)
        except json.JSONDecodeError:
            if text[start] == "[":
                whole = _elements(text, start + 1)
                if whole:
                    return whole
            elif (inner := text.find("[", start)) >= 0:
                whole = _elements(text, inner + 1)
                if whole:
                    return whole
        else:
            if isinstance(value, dict):
                value = value.get("nuggets", [value])
            if isinstance(value, list) and all(isinstance(v, dict) for v in value):
                return value
        at = re.compile(r"[\[{]").search(text, start + 1)
    return None


def _elements(text: str, at: int) -> list[dict]:
    """The objects that follow one another from a position on, up to the first broken one."""
    out = []
    while m := re.compile(r"\s*,?\s*(?=\{)").match(text, at):
        try:
            value, at = _DECODER.raw_decode(text, m.end())
        except json.JSONDecodeError:
            break
        out.append(value)
    return out


def _rating(value: object) -> int:
    try:
        return min(5, max(1, int(value)))
    except (TypeError, ValueError):
        return 3


PAIR_SCHEMA = "item int, question string, answer string, type string, relevance int, specificity int, self_contained int, thesis_relevance int, overall int"
_RATINGS = ("relevance", "specificity", "self_contained", "thesis_relevance")


@for_workers
def extracted_pairs(answers: DataFrame, answer_id: str, raw: str, least: int = 10) -> DataFrame:
    """id and the question-answer pairs in raw model answers, at least ``least`` characters
    each; ratings clamped to 1..5 (3 where there is none), overall the least of the first three."""
    kind = answers.schema[answer_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, o in enumerate(json_objects(text or "") or []):
                    q, a = str(o.get("question", "")).strip(), str(o.get("answer", "")).strip()
                    if len(q) >= least and len(a) >= least:
                        r = [_rating(o.get(n, 3)) for n in _RATINGS]
                        out.append((i, k, q, a, str(o.get("type", "background")), *r, min(r[:3])))
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 5]
            cols = list(zip(*out)) if out else [[]] * len(types)
            names = ["id", *[c.strip().split(" ")[0] for c in PAIR_SCHEMA.split(",")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return answers.select(answer_id, raw).mapInArrow(run, f"id {kind}, {PAIR_SCHEMA}")


# ---------------------------------------------------------------- references

# How names of venues begin.
_VENUE_NAMES = ("IEEE", "ACM", "CVPR", "ICCV", "ECCV", "NeurIPS", "ICML", "AAAI", "Proc", "Conf", "Trans", "Int. Conf", "Eur. Conf", "arXiv", "Springer", "LNCS", "Frontiers")
_VENUE = re.compile(r"(?i)\b(?:" + "|".join(re.escape(v) for v in _VENUE_NAMES) + ")")
_QUOTES = {'"': '"', "“": "”"}
_LEAST_ENTRY = 20


def _mark(line: str) -> tuple[str, int, str] | None:
    """The style, number and rest of a line that begins with the mark of a numbered entry."""
    bare = line.lstrip()
    digits = bare.lstrip("[")[: len(bare)]
    n = len(digits) - len(digits.lstrip("0123456789"))
    if not n:
        return None
    number, rest = int(digits[:n]), digits[n:]
    if bare[0] == "[" and rest[:1] == "]":
        return "bracket", number, rest[1:].strip()
    if bare[0].isdigit() and rest[:1] == "." and rest[1:2].isspace() and rest[1:].strip()[:1].isupper():
        return "dot", number, rest[1:].strip()
    return None


def reference_list(text: str) -> list[str]:
    """The entries of a list of references. Of the two styles of numbering the one with the
    longer run of rising numbers marks the entries, where it has at least three; otherwise
    blank lines part them. Words cut at a line end are joined, short entries dropped."""
    lines = text.split("\n")
    marks = {i: m for i, line in enumerate(lines) if (m := _mark(line))}
    runs: dict[str, list[int]] = {"bracket": [], "dot": []}
    last = {"bracket": 0, "dot": 0}
    for i, (style, number, _) in marks.items():
        if number > last[style]:
            runs[style].append(i)
            last[style] = number
    starts = max(runs.values(), key=len)
    if len(starts) >= 3:
        groups = [[marks[i][2], *lines[i + 1 : j]] for i, j in zip(starts, [*starts[1:], len(lines)])]
    else:
        groups = [[]]
        for line in lines:
            if line.strip():
                groups[-1].append(line)
            elif groups[-1]:
                groups.append([])
    entries = []
    for group in groups:
        whole = ""
        for line in map(str.strip, group):
            cut_word = whole[-1:] == "-" and whole[-2:-1].isalpha() and line[:1].isalpha()
            whole = whole[:-1] + line if cut_word else f"{whole} {line}".strip()
        if len(whole := " ".join(whole.split())) > _LEAST_ENTRY:
            entries.append(whole)
    return entries


def _entry_parts(entry: str) -> list[tuple[str, bool]]:
    """The parts of an entry and whether each is quoted: quotations stand for themselves, the
    rest is parted at full stops that end a word and no initial, before a capital or a year."""
    parts: list[tuple[str, bool]] = []
    begin = at = 0
    while at < len(entry):
        c = entry[at]
        end = entry.find(_QUOTES[c], at + 1) if c in _QUOTES else -1
        if end > at + 10:
            parts += [(entry[begin:at], False), (entry[at + 1 : end], True)]
            at = begin = end + 1
            continue
        ahead = entry[at + 1 : at + 8].lstrip()[:4]
        if c == "." and entry[at + 1 : at + 2].isspace() and (ahead[:1].isupper() or _year_of(ahead)):
            word = entry[:at].rsplit(None, 1)[-1] if entry[:at].strip() else ""
            if len(word) > 1 and word[-2:].isalnum() and not word[-1].isupper():
                parts.append((entry[begin:at], False))
                begin = at + 1
        at += 1
    parts.append((entry[begin:], False))
    return [(p.strip(" ,.;"), q) for p, q in parts if p.strip(" ,.;")]


def _year_of(entry: str) -> str:
    years = [w for w in re.split(r"\D+", entry) if len(w) == 4 and 1980 <= int(w) <= 2029]
    if years:
        return years[-1]
    number = re.search(r"(?i)arxiv\W*(\d\d)\d\d\.\d+", entry)
    return f"20{number.group(1)}" if number else ""


def _title_score(part: str, quoted: bool, place: int) -> float:
    """How much a part looks like a title: words in lower case speak for it, initials, commas,
    figures and the name of a venue against it."""
    words = part.split()
    initials = sum(len(w.strip(".,")) == 1 and w[0].isupper() for w in words)
    score = 100.0 * quoted + sum(w[0].islower() for w in words) - 2 * initials - part.count(",") - sum(c.isdigit() for c in part)
    return score - (6 if _VENUE.match(part) and len(part) < 60 else 0) - 0.5 * place


def reference_fields(entry: str) -> dict[str, str]:
    """authors, title, year and venue of one entry; what cannot be told is ''. The part that
    looks most like a title is the title, what stands before it names the authors, what stands
    behind it the venue, without year, pages, volume and number."""
    parts = _entry_parts(entry)
    if len(parts) < 2:
        return {"authors": "", "title": parts[0][0] if parts else "", "year": _year_of(entry), "venue": ""}
    at = max(range(len(parts)), key=lambda k: (_title_score(*parts[k], k), -k))
    authors = ". ".join(p for p, _ in parts[:at])
    kept = []
    for piece in ", ".join(p for p, _ in parts[at + 1 :]).split(","):
        bare = piece.strip(" .")
        first = bare.lower().split(".")[0].split(" ")[0]
        if bare and first not in ("pp", "p", "vol", "no", "pages") and not bare.replace("-", "").replace("–", "").isdigit():
            kept.append(re.sub(r"(?i)^in(?::\s*|\s+)", "", bare))
    venue = re.sub(r"[\s\d]+$", "", ", ".join(kept)).strip(" ,.")
    return {"authors": authors, "title": parts[at][0], "year": _year_of(entry), "venue": venue}


@for_workers
def reference_rows(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """id, entry, authors, title, year, venue: the references in texts that are such lists."""
    kind = texts.schema[text_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                {"id": i, "entry": e, **reference_fields(e)}
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for e in reference_list(t or "")
            ]
            names = ["entry", "authors", "title", "year", "venue"]
            cols = [pa.array([r["id"] for r in rows], b.schema.field(0).type), *[pa.array([r[n] for r in rows], pa.string()) for n in names]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *names])

    return texts.select(text_id, text).mapInArrow(run, f"id {kind}, entry string, authors string, title string, year string, venue string")


# ---------------------------------------------------------------- pages


def reading_order(blocks: DataFrame) -> DataFrame:
    """page_id, text: the blocks of each page in reading order.

    ``blocks`` has page_id, x0, y0, x1, y1, text, page_width, page_height. Wide blocks in the
    top 8 % come first, those in the bottom 8 % last. Where at least two of the other blocks
    begin clearly left and two clearly right of the middle, the left column is read first.
    """
    b = blocks.where(F.trim("text") != "")
    wide = (F.col("x1") - F.col("x0")) >= F.col("page_width") * 0.6
    band = F.when(wide & (F.col("y0") < F.col("page_height") * 0.08), 0).when(wide & (F.col("y1") > F.col("page_height") * 0.92), 2).otherwise(1)
    middle, margin = F.col("page_width") / 2, F.col("page_width") * 0.15
    body = F.col("band") == 1
    columns = (
        b.withColumn("band", band)
        .groupBy("page_id")
        .agg(
            F.count(F.when(body & (F.col("x0") < middle - margin), True)).alias("left"),
            F.count(F.when(body & (F.col("x0") > middle + margin), True)).alias("right"),
            F.collect_list(
                F.struct("band", (F.col("x0") >= middle).cast("int").alias("side"), "y0", "x0", F.trim("text").alias("text"))
            ).alias("all"),
        )
    )
    two = (F.col("left") >= 2) & (F.col("right") >= 2)
    keyed = F.transform("all", lambda x: F.struct(x["band"], F.when(two & (x["band"] == 1), x["side"]).otherwise(0), x["y0"], x["x0"], x["text"].alias("text")))
    return columns.select("page_id", F.array_join(F.transform(F.array_sort(keyed), lambda x: x["text"]), "\n").alias("text"))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word -> positions)."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


# ---------------------------------------------------------------- source code


def _outline(source: str) -> list[dict]:
    """Classes and functions of Python source, with what they are made of."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []

    def function(node: ast.AST) -> str:
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return f"{node.name}({ast.unparse(node.args)}){returns}"

    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            members = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            fields = [ast.unparse(n) for n in node.body if isinstance(n, ast.AnnAssign)]
            decorated = any("dataclass" in ast.unparse(d) for d in node.decorator_list)
            made = [
                ast.unparse(s)
                for f in members
                if f.name == "__init__"
                for s in f.body
                if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call)
            ]
            out.append({
                "kind": "class", "name": node.name, "signature": ", ".join(ast.unparse(b) for b in node.bases), "doc": ast.get_docstring(node),
                "members": [function(f) for f in members if not f.name.startswith("_") or f.name in ("__init__", "__call__")],
                "fields": fields if decorated else [], "components": made,
            })
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append({"kind": "function", "name": node.name, "signature": function(node), "doc": ast.get_docstring(node), "members": [], "fields": [], "components": []})
    return out


@for_workers
def code_outline(files: DataFrame) -> DataFrame:
    """file, kind, name, signature, doc, members, fields, components: the classes and functions
    of Python files (file, source). Files that do not parse have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": f, **o} for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for o in _outline(s or "")]
            text, texts = pa.string(), pa.list_(pa.string())
            names = {"file": text, "kind": text, "name": text, "signature": text, "doc": text, "members": texts, "fields": texts, "components": texts}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in names.items()], names=list(names))

    schema = "file string, kind string, name string, signature string, doc string, members array<string>, fields array<string>, components array<string>"
    return files.select("file", "source").mapInArrow(run, schema)


def flattened(value: object, prefix: str = "") -> dict[str, str]:
    """Nested settings as dotted keys."""
    if isinstance(value, dict):
        out: dict[str, str] = {}
        for k, v in value.items():
            out.update(flattened(v, f"{prefix}.{k}" if prefix else str(k)))
        return out
    return {prefix: value if isinstance(value, str) else json.dumps(value)}


@for_workers
def run_settings(files: DataFrame) -> DataFrame:
    """file, key, value: the settings of JSON (or, where a parser is there, YAML) files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import yaml

            load = yaml.safe_load
        except ImportError:
            load = json.loads
        for b in batches:
            rows = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(f, k, v) for k, v in flattened(load(s or "{}")).items() if k]
                except Exception:  # noqa: BLE001 - a broken file has no settings
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["file", "key", "value"])

    return files.select("file", "source").mapInArrow(run, "file string, key string, value string")
