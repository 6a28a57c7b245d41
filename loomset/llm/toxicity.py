"""Toxicity by a grammar of weighted finite-state transducers over clauses.

Words become symbols: insult, threatening verb, target, negation, reporting verb, one that tells
intent, or other. Five transducers read the symbols of a clause; each arc has a weight, and the machine
they are composed into adds the weights of what its parts do. The first finds threats: a verb with a
target after it, or a target and intent before it. The second takes weight from insults and
threats behind a negation, the third from reported ones, the fourth adds to insults with a target on
either side, the last takes insults that stand alone for no clause. With the weights of the insults
themselves that makes the weight of a clause, and a document is scored on the weights of its matched
clauses, never on words.

Which words insult is learned: besides a short list per language, stems that labelled toxic texts
share, weighted by how much more often they do than other texts. From which weight on a document
is likely toxic is learned as well, both from a bounded sample of labelled rows; without labelled texts
of both kinds the short list and fixed figures take their place.

A null or empty text matches nothing and gets the score of a text without a match. Texts of any
length are read whole. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.samples import labelled_sample
from loomset.llm.workers import add_columns, per_worker, unused

PREDICT = 0.7

# Words of the grammar in English, German, French and Spanish, in lower case.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless clown clowns "
    "disgusting imbecile dumbass bastard filth vermin degenerate "
    "idioten dummkopf abschaum trottel versager widerlich erbärmlich wertlos blödmann "
    "imbécile crétin ordure pathétique dégoûtant minable abruti connard "
    "idiota estúpido estúpida imbécil basura escoria patético patética asqueroso perdedor".split()
)
# Verbs that threaten the target after them, and forms that threaten one before them as well.
THREATS = frozenset("kill murder destroy hurt stab shoot beat burn hang strangle".split())
DOOMS = frozenset(
    "killed murdered destroyed stabbed shot beaten burned burnt hanged strangled "
    "töten umbringen vernichten erschießen erwürgen "
    "tuer détruire égorger étrangler massacrer "
    "matar destruir golpear estrangular apuñalar".split()
)
TARGETS = frozenset(
    "you your yours yourself he she him her they them people "
    "du dich dir dein deine ihr euch sie ihn leute "
    "tu toi te ton ta vous votre ils elles eux gens "
    "tú ti usted ustedes vosotros ellos ellas gente".split()
)
NEGATIONS = frozenset(
    "not no never neither nor isn aren wasn don doesn didn cannot without "
    "nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún sin".split()
)
REPORTS = frozenset(
    "said says say told tells called calls wrote writes quoted claimed claims reported "
    "sagte sagt nannte schrieb behauptet berichtet "
    "dit disait appelé écrit affirme raconte dijo dice llamó escribió afirma cuenta".split()
)

# Words that tell intent, with a threatening verb.
INTENTS = frozenset(
    "i we ll will shall should must gonna going deserve ought "
    "ich wir werde werden sollst sollte muss je nous vais vas allons devrais yo voy vamos debes".split()
)

# Weights of the grammar. Learned insults mostly have 3 to 8.
THREATENED, AIMED = 14.0, 2.0
NEGATED, REPORTED, ALONE = -14.0, -8.0, -20.0

# Without labelled texts of both kinds.
PLAIN_WEIGHTS, PLAIN_BIAS = (1.0, 1.0), -2.5

# A stem needs this many toxic texts and this much higher a rate among them.
STEM_TEXTS = 8
STEM_RATIO = 5.0
STEMS = 400
STEM_LENGTHS = range(3, 13)
_UNSEEN_WEIGHT = 2.0

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLAUSE_END = re.compile(r"[.!?;:\n]+")
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

# --- transducers ----------------------------------------------------------------------------------

INSULT, VERB, DOOM, TARGET, NEGATION, REPORT, INTENT, OTHER = "I", "V", "D", "T", "N", "R", "M", "w"
# What the first machine writes where a threat is complete, and what stands after a clause.
THREAT, END = "K", "$"
SYMBOLS = (INSULT, VERB, DOOM, TARGET, NEGATION, REPORT, INTENT, OTHER, THREAT, END)

Step = Callable[[Hashable, str], tuple[Hashable, str, float]]


@dataclass
class Transducer:
    """From a state and an input symbol to the next state, an output symbol and a weight. States are
    numbers from 0, the start. An arc that is not listed stays, copies its input and weighs
    nothing."""

    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        """What is written for a clause, and the sum of its weights."""
        state, written, weight = 0, [], 0.0
        for symbol in symbols:
            state, out, more = self.step(state, symbol)
            written.append(out)
            weight += more
        return written, weight

    @classmethod
    def of(cls, start: Hashable, step: Step) -> Transducer:
        """The machine with the states that ``step`` reaches from ``start``."""
        number, todo, machine = {start: 0}, [start], cls()
        while todo:
            state = todo.pop()
            for symbol in SYMBOLS:
                onward, out, weight = step(state, symbol)
                if onward not in number:
                    number[onward] = len(number)
                    todo.append(onward)
                machine.arcs[number[state], symbol] = (number[onward], out, weight)
        return machine


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second`` and adds their weights."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
        a, middle, weight = first.step(state[0], symbol)
        b, out, more = second.step(state[1], middle)
        return (a, b), out, weight + more

    return Transducer.of((0, 0), step)


def _less(*counters: int) -> tuple[int, ...]:
    return tuple(max(0, counter - 1) for counter in counters)


def threats() -> Transducer:
    """Writes a threat in the place of a target up to three words after a threatening verb, or of
    a verb form that may stand behind its target, if a target and a word of intent stand up to five
    words before it."""

    def step(state, symbol):
        verb, target, intent = state
        if symbol == TARGET:
            return (0, 5, _less(intent)[0]), *((THREAT, THREATENED) if verb else (TARGET, 0.0))
        if symbol == DOOM and target and intent:
            return (0, 0, 0), THREAT, THREATENED
        verb, target, intent = _less(verb, target, intent)
        if symbol in (VERB, DOOM):
            return (3, target, intent), OTHER, 0.0
        if symbol == INTENT:
            return (verb, target, 5), OTHER, 0.0
        return (verb, target, intent), symbol, 0.0

    return Transducer.of((0, 0, 0), step)


def negations() -> Transducer:
    """Takes weight from insults and threats up to four words after a negation."""

    def step(left, symbol):
        if symbol == NEGATION:
            return 4, symbol, 0.0
        return max(0, left - 1), symbol, NEGATED if left and symbol in (INSULT, THREAT) else 0.0

    return Transducer.of(0, step)


def reports() -> Transducer:
    """Takes weight from all insults and threats after a reporting verb."""

    def step(told, symbol):
        weight = REPORTED if told and symbol in (INSULT, THREAT) else 0.0
        return told or symbol == REPORT, symbol, weight

    return Transducer.of(False, step)


def targets() -> Transducer:
    """Adds weight to insults with a target up to four words before or after them."""

    def step(state, symbol):
        target, insult = state
        if symbol in (TARGET, THREAT):
            return (4, 0), symbol, AIMED if insult else 0.0
        if symbol == INSULT:
            return (*_less(target), 0 if target else 4), symbol, AIMED if target else 0.0
        return _less(target, insult), symbol, 0.0

    return Transducer.of((0, 0), step)


def lone_words() -> Transducer:
    """Takes the weight of an insult that is all of its clause."""

    def step(state, symbol):
        if symbol == END:
            return "", symbol, ALONE if state == INSULT else 0.0
        return INSULT if (state, symbol) == ("", INSULT) else OTHER, symbol, 0.0

    return Transducer.of("", step)


MACHINES = (threats, negations, reports, targets, lone_words)


def grammar() -> Transducer:
    return reduce(compose, [machine() for machine in MACHINES])


# Features of a document: the weight of its matched clauses, and that weight for each 40 words.
FEATURES = 2


@dataclass
class Lexicon:
    """Insults and their weights: whole words, and stems that longer words start with."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self) -> None:
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def read(self, word: str) -> tuple[str, float]:
        """Symbol and weight of a word in lower case."""
        if word in self.words:
            return INSULT, self.words[word]
        for n in self.lengths:
            if n < len(word) and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        for names, symbol in (
            (THREATS, VERB),
            (DOOMS, DOOM),
            (TARGETS, TARGET),
            (NEGATIONS, NEGATION),
            (REPORTS, REPORT),
            (INTENTS, INTENT),
        ):
            if word in names:
                return symbol, 0.0
        return OTHER, 0.0

    def automaton(self):
        """Finds texts with any match: words and stems after a space."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in [f" {w} " for w in {*self.words, *THREATS, *DOOMS}] + [f" {s}" for s in self.stems]:
            found.add_word(phrase, 1)
        found.make_automaton()
        return found


def fold(text: str) -> str:
    """Words in lower case, with one space before and after each."""
    return " " + b" ".join(text.lower().encode().translate(_FOLD).split()).decode() + " "


def clause_weights(text: str, lexicon: Lexicon, machine: Transducer) -> tuple[list[float], int]:
    """The weights of the matched clauses of a text, and how many words it has. A clause that weighs
    nothing or less is no match."""
    seen: dict[str, tuple[str, float]] = {}
    found, words = [], 0
    for clause in _CLAUSE_END.split(text.lower()):
        state, weight = 0, 0.0
        for word in _WORD.findall(clause):
            words += 1
            if word not in seen:
                seen[word] = lexicon.read(word)
            symbol, own = seen[word]
            state, _, more = machine.step(state, symbol)
            weight += own + more
        weight += machine.step(state, END)[2]
        if weight > 0:
            found.append(weight)
    return found, words


def match_features(text: str, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    weights, words = clause_weights(text, lexicon, machine)
    return np.log1p([sum(weights), 40 * sum(weights) / max(words, 20)])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.name = hash((tuple(self.weights), self.bias, tuple(sorted(self.lexicon.stems))))

    def scores(self, texts: list[str]) -> np.ndarray:
        finder = per_worker(("toxic words", self.name), self.lexicon.automaton)
        machine = per_worker("grammar", grammar)
        found = np.zeros((len(texts), FEATURES))
        for i, text in enumerate(texts):
            if next(finder.iter(fold(text)), None) is not None:
                found[i] = match_features(text, self.lexicon, machine)
        return 1 / (1 + np.exp(-np.clip(found @ self.weights + self.bias, -30, 30)))


# --- fitting --------------------------------------------------------------------------------------


def _distinct(texts: list[str], toxic: list[int]) -> list[tuple[set[str], int]]:
    """Word sets, one for texts that are copies of each other or nearly so: a text that was
    copied a hundred times would make a hundred witnesses for each of its words."""
    found: dict[tuple, tuple[set[str], int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        words = set(fold(text).split())
        if words:
            ranked = sorted((hash_word(w), w) for w in words)[:2]
            found.setdefault((tuple(ranked), label), (words, label))
    return list(found.values())


def hash_word(word: str) -> int:
    value = 0xCBF29CE484222325
    for byte in word.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value ^ (value >> 29)


def learn_lexicon(texts: list[str], toxic: list[int]) -> Lexicon:
    """Insults of the short list and learned stems, each weighted by its log rate ratio.

    Stems are taken by how much evidence there is for them; one that starts another that is taken
    already, or the other way round, is left.
    """
    bags = _distinct(texts, toxic)
    total = Counter(label for _, label in bags)

    def marks(words: set[str]) -> set[str]:
        """Whole words after a space, and what longer words start with."""
        return {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n} | {f" {w}" for w in words}

    count = (Counter(), Counter())
    for words, label in bags:
        if label:
            count[1].update(marks(words))
    wanted = {s for s, a in count[1].items() if a >= STEM_TEXTS} | {f" {w}" for w in INSULTS}
    for words, label in bags:
        if not label:
            count[0].update(marks(words) & wanted)

    def weight(stem: str) -> float:
        a, b = count[1][stem], count[0][stem]
        return math.log(((a + 0.5) / (total[1] + 1)) / ((b + 0.5) / (total[0] + 1)))

    def evidence(stem: str) -> float:
        a, b = count[1][stem], count[0][stem]
        expected = (a + b) * total[1] / max(1, total[0] + total[1])
        return a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0)

    able = [
        s for s, a in count[1].items() if a >= STEM_TEXTS and weight(s) >= math.log(STEM_RATIO)
    ]
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    # With the same evidence the most special one: a whole word, else the longest stem.
    for stem in sorted(able, key=lambda s: (-evidence(s), s[0] != " ", -len(s), s)):
        if len(stems) + len(words) >= STEMS:
            break
        bare = stem.strip()
        if any(bare != s and bare.startswith(s) for s in stems):
            continue
        if stem[0] == " ":
            words[bare] = weight(stem)
        elif not any(w != bare and w.startswith(bare) for w in [*words, *stems]):
            stems[bare] = weight(stem)
    for insult in INSULTS:
        if insult not in words:
            seen = count[0][f" {insult}"] + count[1][f" {insult}"]
            words[insult] = max(0.1, weight(f" {insult}")) if seen >= 5 else _UNSEEN_WEIGHT
    return Lexicon(words, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    state = np.zeros(design.shape[1])
    penalty = np.diag([*[ridge] * x.shape[1], 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ state, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ state
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty
        change = np.linalg.solve(curve, gradient)
        state -= change
        if np.abs(change).max() < 1e-8:
            break
    return state[:-1], float(state[-1])


def fit_toxicity_rows(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Without texts of both kinds, the model of the short list."""
    if len(set(toxic)) < 2:
        plain = Lexicon(dict.fromkeys(INSULTS, _UNSEEN_WEIGHT), {})
        return ToxicityModel(plain, np.array(PLAIN_WEIGHTS), PLAIN_BIAS)
    lexicon = learn_lexicon(texts, toxic)
    machine = grammar()
    x = np.array([match_features(t, lexicon, machine) for t in texts]).reshape(-1, FEATURES)
    weights, bias = fit_logistic(x, np.array(toxic, float))
    return ToxicityModel(lexicon, weights, bias)


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows: int | None = None) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents, see ``samples``."""
    more = {} if rows is None else {"rows": rows}
    sample = labelled_sample(documents, labels, "toxic", **more)
    return fit_toxicity_rows([row.text for row in sample], [int(row.toxic > 0) for row in sample])


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with ``_score``, the probability that a text is toxic. One pass, no shuffle."""
    return add_columns(df, text, "_score double", lambda texts: [pa.array(model.scores(texts))])


def select_civil(df: DataFrame, model: ToxicityModel, limit: float = PREDICT) -> DataFrame:
    """The rows of ``df`` that are not predicted to be toxic."""
    score = unused(df, "_score")
    scored = add_columns(
        df, "text", f"{score} double", lambda texts: [pa.array(model.scores(texts))]
    )
    return scored.filter(F.col(score) < limit).drop(score)
