"""Whether a sentence is complete: an averaged perceptron over the shape of its words.

It learns without labels: the finished sentences of a sample are complete, and a sentence
broken off somewhere inside is not. Words show by themselves where they are frequent, by their
endings otherwise; features tie the last words and all words of a sentence, and of its last
clause, to the words that opened them. The margin below which a sentence counts as broken off
is set so that of held-out finished sentences at most FALSE_ALARMS fall below it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

#: Words that show by themselves, sentences below which nothing is learned, rounds of
#: training, share of finished sentences that may be taken for broken ones.
LEXICAL, LEAST_SENTENCES, ROUNDS, FALSE_ALARMS = 300, 300, 3, 0.002
#: Words of a sentence that are looked at; longer sentences are not judged.
LONGEST = 80

_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[]*[^\W_])")
_TOKEN = re.compile(r"\d[\d.,]*|[^\W\d_][\w'’-]*|[^\w\s]")
# Abbreviations after which a sentence goes on.
_GOES_ON = re.compile(r"(?:\b(?:et al|e\.g|i\.e|cf|vs|approx|resp|incl|viz|figs?|eqs?|secs?|tab|no|vol|z\.b|d\.h|p\.ej|bzw|ca)|\b[A-Z])\.$", re.I)
# Words and marks that open a clause.
_CLAUSE = set(
    ", ; : while whereas because although though if then otherwise that which where and or but once until since so as when "
    "weil obwohl während dass wenn da und oder parce puisque lorsque bien et ou porque aunque cuando que y o".split()
)


def sentences(text: str) -> list[str]:
    """The sentences of a text; abbreviations end none."""
    out: list[str] = []
    for part in _SPLIT.split(text):
        if out and _GOES_ON.search(out[-1]):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return [s.strip() for s in out if s.strip()]


class SentenceModel:
    """Frequent words, weights of features and the margin."""

    def __init__(self, frequent: set[str]):
        self.frequent, self.weights, self.margin = frequent, {}, 0.0

    def shape(self, token: str, first: bool) -> str:
        low = token.lower()
        if low in self.frequent:
            return low
        if token[0].isdigit():
            return "#"
        if not token[0].isalpha():
            return token
        if token[0].isupper() and not first:
            return "^"
        return "~" + low[-3:]

    def features(self, tokens: list[str]) -> list[str]:
        shapes = [self.shape(t, not k) for k, t in enumerate(tokens)]
        last = shapes[-1]
        begin = 0
        for k in range(len(shapes) - 2, 0, -1):
            if shapes[k] in _CLAUSE:
                begin = k
                break
        clause = shapes[begin:]
        head, opener = shapes[0], clause[0]
        pad = ["<", "<", *shapes]
        out = [
            "bias", f"l {last}", f"m {pad[-2]} {last}", f"n {pad[-3]} {pad[-2]} {last}", f"h {head} {last}", f"o {opener} {last}",
            f"H {head}", f"O {opener}", f"s {min(len(shapes), 6)} {head}", f"c {min(len(clause), 4)} {opener}", f"e {tokens[-1].lower()}",
        ]
        out += [f"w {head} {x}" for x in set(shapes[1:])]
        out += [f"v {opener} {x}" for x in set(clause[1:])]
        out += [f"a {x}" for x in set(shapes)]
        return out

    def score(self, tokens: list[str]) -> float:
        """Above zero for complete sentences."""
        get = self.weights.get
        return sum(get(f, 0.0) for f in self.features(tokens))


def _tokens(sentence: str) -> list[str]:
    tokens = _TOKEN.findall(sentence)
    while tokens and tokens[-1] in ".!?…\"'”’»":
        tokens.pop()
    return tokens


def train(texts: list[str]) -> SentenceModel | None:
    """The model of the sentences of texts that end with a final mark; None for too few."""
    whole = {s: t for x in texts for s in sentences(x) if 2 <= len(t := _tokens(s)) <= LONGEST}
    if len(whole) < LEAST_SENTENCES:
        return None
    keys = sorted(whole, key=lambda s: (zlib.crc32(s.encode()), s))
    counts = Counter(w.lower() for s in keys for w in set(whole[s]) if w[0].isalpha())
    model = SentenceModel({w for w, n in counts.most_common(LEXICAL) if n * 500 >= len(keys)})
    held, learned = keys[: len(keys) // 5], keys[len(keys) // 5 :]
    examples: list[tuple[list[str], int]] = []
    for s in learned:
        tokens = whole[s]
        examples.append((model.features(tokens), 1))
        draw = zlib.crc32(s[::-1].encode())
        for k in {1 + draw % (len(tokens) - 1), 1 + (draw >> 10) % (len(tokens) - 1)}:
            if tokens[:k] and tokens[k - 1] not in ",;:":
                examples.append((model.features(tokens[:k]), -1))
    total: dict[str, float] = defaultdict(float)
    weights: dict[str, float] = defaultdict(float)
    n = 0
    for _ in range(ROUNDS):
        for features, y in examples:
            n += 1
            if y * sum(weights[f] for f in features) <= 1.0:
                for f in features:
                    weights[f] += y
                    total[f] += y * n
    model.weights = {f: w - total[f] / (n + 1) for f, w in weights.items() if w or total[f]}
    scores = sorted(model.score(whole[s]) for s in held)
    model.margin = min(0.0, scores[int(len(scores) * FALSE_ALARMS)])
    return model


def is_beginning(text: str, model: SentenceModel) -> bool:
    """Whether the last sentence of a text, which has no final mark, is broken off. A piece
    that begins with a figure, or has up to three words and stands alone, is a short answer, no
    sentence."""
    parts = sentences(text)
    if not parts:
        return False
    tokens = _tokens(parts[-1])
    if not tokens or len(tokens) > LONGEST or len(parts) == 1 and len(tokens) <= 3 or not tokens[0][0].isalpha():
        return False
    return model.score(tokens) < model.margin
