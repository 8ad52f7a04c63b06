"""The language of a text by profiles of character n-grams, and its script.

A profile is made from the commonest words of a language: each word, between boundary marks,
gives its n-grams the weight that Zipf's law gives its rank. A text is scored word by word, so
that one odd word (a name, a term) cannot outweigh the rest.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache

# Common words of each language, the commonest first.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his are this from at which or an have has had "
    "but were their they its been would there can will what when where who how why does do did if than then while "
    "whereas although because until once so any each both neither nor our we after before under near within without "
    "during across despite beyond only a i you more other some such these those between through about into over most "
    "also used using reaches keeps shows gives needs costs loses since though against every across many",
    "de": "der die das und ist nicht ein eine einen einem einer eines den dem des zu mit von auf für im sich auch als "
    "an werden wird aus er hat dass sie nach bei um am sind noch wie über so zum war haben nur oder aber vor zur bis "
    "mehr durch man kann dann wenn weil obwohl während wir ihre dabei damit danach da unter warum welche ich welcher "
    "wurde sowie zwischen gegen jedoch diese dieser dieses keine seine ihrer ohne zunächst früher erreicht benötigt "
    "zeigen verfahren werte bleibt sehr schon hier alle können müssen",
    "fr": "le la les de des du et un une est en que qui dans pour pas sur plus par avec ce il sont au aux se ne ou "
    "mais comme nous vous leur on cette ces sa son ses été être d l qu n s c j à lors lorsque bien car puisque quand "
    "pourquoi comment quel quelle sous sans ainsi entre je elle ils dont même tout tous très fait peut selon après "
    "avant depuis toujours aussi reste atteint permet méthode auteurs montrons chaque donc encore moins",
    "es": "el la los las de del y un una es en que por para con no se su al lo como más o pero sus le ha me si sin "
    "sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde mi porque qué cómo cuál "
    "aunque así tras solo sólo nos sigue siendo yo hay donde quien durante cada estos estas puede después antes "
    "mismo otra otro método alcanza autores mostramos según mientras luego nunca siempre",
    "it": "di e il la che in un una è per non con del della le si da i al dei lo come più ma gli delle nel alla sono "
    "anche se ha su questo questa o ci nella dal sua suo essere stato loro tra quando dove perché così molto dopo "
    "prima senza ogni quale quali cui mentre poi solo tutti può fare degli alle negli dalla sul sulla dello ed "
    "hanno era viene questi queste metodo rete dati risultati ancora sempre quindi però",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu "
    "sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter "
    "seus quem nas me esse eles estão você tinha foram essa num nem suas às minha têm numa pelos elas havia seja "
    "qual será nós tenho lhe porque onde enquanto embora não são método autores ainda então",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als die maar bij door naar uit over dan "
    "zich nog wordt of worden tot hij ze kan meer wel deze geen al zo heeft was hebben waar wat hun onder na "
    "tussen zonder omdat terwijl wanneer waarom welke hoe dit zou we ik je niet veel andere alleen tegen tijdens "
    "daarna eerst elke beide hoewel zodat methode blijft bereikt onze wij",
    "sv": "och att det i en som på är av för med till den har de inte om ett men var jag sig från vi så kan när man "
    "efter eller under nu också än där hur mot vad alla mycket över bara får ut finns hade ska vid utan mellan "
    "eftersom medan innan varje båda detta denna dessa metoden varför vilken blir sedan några sin sitt",
    "pl": "w i na z do nie się to jest że o jak po za od przez dla co ale czy są ze jego może być tylko oraz już "
    "który która które był była przy jej tak lub gdy kiedy bez między ponieważ podczas każdy oba metoda "
    "dlaczego jednak także jeszcze bardzo więc tego tej tym nad pod przed",
}
LANGUAGES = tuple(COMMON_WORDS)
#: Most that one word may speak for one language against another, in nats.
MOST_PER_WORD = 4.0
#: Leads, in nats, from which an answer and a question are taken to be in one language rather
#: than in the other's. Questions are shorter and in the language of the table as a rule.
SURE_ANSWER, SURE_QUESTION = 6.0, 4.5

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LATIN = re.compile(r"(?![Ḁ-ỿⱠ-Ɀ꜠-ꟿ＀-～])[^\W\d_\u0000-ͯ]")


def _grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + ([w] if len(w) > 4 or len(w) < 4 else [])


def _profiles() -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """The log probability of each n-gram in each language, and of one that is not there."""
    counts: list[dict[str, float]] = []
    for words in COMMON_WORDS.values():
        own: dict[str, float] = defaultdict(float)
        for rank, w in enumerate(dict.fromkeys(words.split())):
            for g in _grams(w):
                own[g] += 1 / (rank + 12)
        counts.append(own)
    every = set().union(*counts)
    smooth = 0.01
    totals = [sum(c.values()) + smooth * len(every) for c in counts]
    table = {g: tuple(math.log((c.get(g, 0.0) + smooth) / t) for c, t in zip(counts, totals)) for g in every}
    return table, tuple(math.log(smooth / t) for t in totals)


_TABLE, _NONE = _profiles()


@lru_cache(maxsize=50_000)
def _word_scores(word: str) -> tuple[float, ...]:
    """How much a word speaks for each language, relative to their mean, bounded."""
    found = [_TABLE[g] for g in _grams(word) if g in _TABLE]
    if not found:
        return (0.0,) * len(LANGUAGES)
    sums = [sum(col) for col in zip(*found)]
    size = max(1.0, len(found) ** 0.5)  # n-grams of one word are not independent
    mean = sum(sums) / len(sums)
    half = MOST_PER_WORD / 2
    return tuple(min(half, max(-half, (s - mean) / size)) for s in sums)


def scores(text: str) -> tuple[float, ...]:
    """The evidence for each language: words in lower case, each counted once. Words with a
    capital letter are names as a rule, but for the first."""
    words = _WORD.findall(text)
    chosen = {w for w in words if w.islower()}
    if words:
        chosen.add(words[0].lower())
    if len(chosen) < 3 and text.isupper():
        chosen = {w.lower() for w in words}
    total = [0.0] * len(LANGUAGES)
    for w in chosen:
        if len(w) <= 24:
            for i, s in enumerate(_word_scores(w)):
                total[i] += s
    return tuple(total)


def script(text: str) -> str | None:
    """The script of most letters, where it is not Latin."""
    if text.isascii():
        return None
    foreign = _NOT_LATIN.findall(text)
    if len(foreign) <= 0.5 * len(_LETTER.findall(text)):
        return None
    c = ord(foreign[len(foreign) // 2])
    return "greek" if c < 0x400 else "cyrillic" if c < 0x530 else f"script{c // 0x400}"


def language(text: str) -> tuple[str | None, float]:
    """The likeliest language (script for others than Latin), or None, and its lead over the next."""
    if (s := script(text)) is not None:
        return s, math.inf
    found = sorted(zip(scores(text), LANGUAGES), reverse=True)
    lead = found[0][0] - found[1][0]
    return (found[0][1], lead) if lead > 0 else (None, 0.0)


def differs(question: str, answer: str) -> bool:
    """Whether the answer is in another language than the question: each is surely in its own
    rather than in the other's."""
    a, q = script(answer), script(question)
    if a or q:
        return a != q and bool(_LETTER.search(question)) and bool(_LETTER.search(answer))
    sa, sq = scores(answer), scores(question)
    ia, iq = max(range(len(sa)), key=sa.__getitem__), max(range(len(sq)), key=sq.__getitem__)
    return ia != iq and sa[ia] - sa[iq] >= SURE_ANSWER and sq[iq] - sq[ia] >= SURE_QUESTION
