"""Toxicity of texts: a lexicon trie intersected with Levenshtein automata, and scores of context windows.

The lexicon is a trie of words and stems: fixed terms of abuse, and stems (beginnings of words) that mark toxic training
rows; a stem stands for all words that begin with it. A word is matched by the automaton of all words within one edit
(insertion, deletion, substitution, or two neighbouring letters exchanged) of a word of at least FUZZY letters or a stem of at
least FUZZY_STEM, and by the plain trie for shorter ones. Both are intersected once, on the driver, into a deterministic table
over letter classes: one for each letter that the lexicon has (upper case, digits and signs that stand for letters
folded to it) and one for all other letters and digits, whatever their script, which are no letter of any term. All words of
a batch run through the table together.

Each hit is weighed by its window, WINDOW words to either side on its line: it counts less between quotation marks or beside words
of report ("said", "called", "the word"), more beside the second person. It is weighed, too, by how toxic the training
documents with that form of the word are; a form that training has not seen counts like all forms of its term
together, and without any like a fixed prior. The sum of weights and its density go through a logistic
regression. Stems and weights are learned from labelled rows: a sample of at most TRAINING_ROWS, chosen by a hash. A stem
is learned if its share of toxic texts can't be chance (FALSE_SHARE of those learned may be), with no shortest number of
documents, so that languages with few labelled rows have theirs.

Edge cases: null and empty texts have no hits and get the base score; rows without doc_id are scored and never
learned from; repeated rows are scored alike, and copies of a labelled row count as one; without training rows of both
classes the score follows from fixed weights; an empty table gives an empty result; other columns are not inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, lgamma, log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, stats

#: Terms of abuse (fixed values).
LEXICON = (
    "idiot idiotic moron moronic imbecile cretin stupid dumb dumbass fool foolish dimwit halfwit nitwit loser scum scumbag trash garbage filth filthy vermin parasite worthless pathetic disgusting disgrace repulsive vile "
    "clown buffoon jerk bastard bitch asshole arsehole bullshit shit shithead fuck fucker fucking motherfucker dickhead douchebag wanker twat prick slut whore pig swine freak creep retard retarded "
    "trottel dummkopf arschloch abschaum versager widerlich schwachkopf connard salope ordure minable imbécile degoutant estupido estúpido basura asqueroso patetico patético gilipollas"
).split()
#: Ordinary words within one edit of a term (fixed values).
ORDINARY = frozenset(
    "lower lover closer laser loose lose loses loner lost user poser crash brash thrash crown brown clone crow food foot tool pool wool folly garage fifth file mile vine vice voile bile tile pile wile while jerky "
    "perk jeep merc pigs big dig fig pick price bricks brick trick greek break creek freed fresh reek fright crept crop steep shift shirt shot short ship duck luck tuck buck folk funk puck witch batch ditch pitch bit "
    "swing twine spine shine wine when where shore chore whole slit slot slat scam scrum drum plum numb dump dome tumb thumb dun foil pathetics ordures ordre mentor motor moral maroon".split()
)
#: Letters from which a term, and a stem, is matched with one edit.
FUZZY, FUZZY_STEM = 5, 7
#: Words to either side of a hit that make its window, and the weights of a hit.
WINDOW = 8
EDITED, QUOTED, ADDRESSED = 0.7, 0.25, 1.25
#: Most labelled rows that stems and weights are learned from, and most stems that are learned, the surest first.
TRAINING_ROWS = 20_000
LEARNED = 400
#: Letters of a stem, how much likelier its words are in toxic texts, and the share of stems that may be learned by chance.
STEM = range(4, 13)
LIKELIER, FALSE_SHARE = 15.0, 0.02
THRESHOLD = 0.3

_REPORT = frozenset("said says say saying wrote writes called calling quote quoted quotes quoting word words term terms insult insults slur slurs sagte nannte wort dit mot dijo palabra".split())
_SECOND = frozenset("you your youre u ur du dich dein tu toi te usted eres vous ihr".split())
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Classes of code points: 0 between words, 1 any letter or digit that no term has, from 2 on those of the terms.
_BETWEEN, _OTHER = 0, 1


class Machine:
    """The automaton of a lexicon, in the given order; a term that ends in "*" is a stem.

    table[state, class] is the next state (0: dead, 1: start); an accepting state has its term (else -1) and edits.
    """

    def __init__(self, terms: tuple[str, ...], fuzzy: int = FUZZY, fuzzy_stem: int = FUZZY_STEM) -> None:
        letters = sorted({c for t in terms for c in t.removesuffix("*")})
        self.terms = terms
        self.classes = _alphanumeric().astype(np.int16)
        for k, c in enumerate(letters, 2):
            for x in {c, c.upper(), *(d for d, a in _STANDS_FOR.items() if a == c)}:
                if len(x) == 1:
                    self.classes[ord(x)] = k
        number = {c: k for k, c in enumerate(letters, 2)}
        kids: list[dict[int, int]] = [{}, {}]  # nodes; 0 is the root of exact terms, 1 of those that allow an edit
        end: dict[int, int] = {}
        stems: set[int] = set()
        for k, t in enumerate(terms):
            stem, t = t.endswith("*"), t.removesuffix("*")
            for root in (0, 1) if len(t) >= (fuzzy_stem if stem else fuzzy) else (0,):
                node = root
                for c in t:
                    if number[c] not in kids[node]:
                        kids[node][number[c]] = len(kids)
                        kids.append({})
                    node = kids[node][number[c]]
                end.setdefault(node, k)
                if stem:
                    stems.add(node)
        exact_nodes = {0}
        todo = [0]
        while todo:
            new = list(kids[todo.pop()].values())
            exact_nodes.update(new)
            todo += new

        # NFA states (node, edits, pending): pending is the class that completes an exchange, or -1. A stem's end stays, whatever follows.
        def closed(states: set[tuple[int, int, int]]) -> frozenset[tuple[int, int, int]]:
            """Adds deletions: letters of the term that the word lacks."""
            more = {(m, 1, -1) for n, e, p in states if e == 0 and p < 0 and n not in exact_nodes for m in kids[n].values()}
            return frozenset(states | more)

        def step(states: frozenset[tuple[int, int, int]], c: int) -> frozenset[tuple[int, int, int]]:
            out: set[tuple[int, int, int]] = set()
            for n, e, p in states:
                if p >= 0:
                    if c == p:
                        out.add((n, 1, -1))
                    continue
                if n in stems:
                    out.add((n, e, -1))
                if c in kids[n]:
                    out.add((kids[n][c], e, -1))
                if e == 0 and n not in exact_nodes:
                    out.add((n, 1, -1))  # one letter too many
                    for x, m in kids[n].items():
                        out.add((m, 1, -1))  # another letter
                        if c in kids[m] and x != c:
                            out.add((kids[m][c], 1, x))  # this letter comes early, x has to follow
            return closed(out)

        start = closed({(0, 0, -1), (1, 0, -1)})
        names = {frozenset(): 0, start: 1}
        order: list[frozenset[tuple[int, int, int]]] = [frozenset(), start]
        rows: list[np.ndarray] = []
        at = 0
        while at < len(order):
            own = order[at]
            row = np.zeros(len(letters) + 2, np.int32)
            # Letters that none of the states looks for all lead where any other letter leads.
            special = {c for n, _, p in own for c in (kids[n] if p < 0 else (p,))} | {c for n, e, p in own if e == 0 and p < 0 and n not in exact_nodes for m in kids[n].values() for c in kids[m]}
            for c in (_OTHER, *special) if own else ():
                t = step(own, c)
                if t not in names:
                    names[t] = len(order)
                    order.append(t)
                if c == _OTHER:
                    row[_OTHER:] = names[t]
                else:
                    row[c] = names[t]
            rows.append(row)
            at += 1
        self.table = np.array(rows)
        self.term, self.edits = np.full(len(order), -1), np.zeros(len(order), np.int64)
        for k, states in enumerate(order):
            best = min(((e, end[n]) for n, e, p in states if p < 0 and n in end), default=None)
            if best:
                self.edits[k], self.term[k] = best


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """1 for each code point that is a letter, a mark or a digit, and 0 for others."""
    import unicodedata

    return np.array([unicodedata.category(chr(k))[0] in "LMN" for k in range(0x110000)], np.int8)


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...], fuzzy: int = FUZZY, fuzzy_stem: int = FUZZY_STEM) -> Machine:
    return Machine(terms, fuzzy, fuzzy_stem)


_QUOTES = [ord(c) for c in "\"“”„«»"]


class Words:
    """The words of texts (runs of letters, digits and signs that stand for letters), by their places in the joined text."""

    def __init__(self, texts: list[str], machine: Machine) -> None:
        self.joined = "\n".join(texts)
        code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.cls = machine.classes[code]
        inside = np.zeros(len(code) + 2, bool)
        inside[1:-1] = self.cls != _BETWEEN
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lens)])
        self.text = np.searchsorted(self.begin, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.lines = np.flatnonzero(code == 10)  # the ends of lines, those between texts among them
        self.quotes = np.flatnonzero(np.isin(code, _QUOTES)) if len(code) else np.zeros(0, np.int64)

    def word(self, w: int) -> str:
        return self.joined[self.start[w] : self.end[w]].lower()


def match(words: Words, machine: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, term, edits) of the words that the automaton accepts."""
    live, state, pos = np.arange(len(words.start)), np.ones(len(words.start), np.int64), words.start.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        state = machine.table[state, words.cls[pos]]
        pos = pos + 1
        done = pos == words.end[live]
        hit = done & (machine.term[state] >= 0)
        if hit.any():
            found.append((live[hit], state[hit]))
        go = ~done & (state != 0)
        live, state, pos = live[go], state[go], pos[go]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    w, s = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    order = np.argsort(w)
    return w[order], machine.term[s[order]], machine.edits[s[order]]


def window_weight(near: set[str], quoted: bool, edits: int) -> float:
    """Weight of a hit from the words around it, and whether it stands between quotation marks."""
    return (EDITED if edits else 1.0) * (QUOTED if quoted or near & _REPORT else ADDRESSED if near & _SECOND else 1.0)


def hits(texts: list[str], machine: Machine) -> tuple[list[tuple[int, str, int, int, float]], np.ndarray]:
    """(text, word, term, edits, weight) of each hit, and the texts' word counts."""
    words = Words(texts, machine)
    w, term, edits = match(words, machine)
    line = np.searchsorted(words.lines, words.start[w])
    first = np.where(line > 0, words.lines[line - 1] if len(words.lines) else 0, -1)  # the end of the line before
    last = words.lines[np.minimum(line, len(words.lines) - 1)] if len(words.lines) else np.zeros(len(w), np.int64)
    last = np.where(line < len(words.lines), last, len(words.joined))
    before = np.searchsorted(words.quotes, words.start[w])
    odd = (before - np.searchsorted(words.quotes, first)) % 2 == 1
    quoted = odd & (np.searchsorted(words.quotes, last) > before)
    low = np.maximum(w - WINDOW, np.searchsorted(words.start, first))
    high = np.minimum(w + WINDOW + 1, np.searchsorted(words.start, last))
    out = []
    for k, t, e, q, a, b in zip(w.tolist(), term.tolist(), edits.tolist(), quoted.tolist(), low.tolist(), high.tolist()):
        form = words.word(k)
        if e and form in ORDINARY:
            continue
        out.append((int(words.text[k]), form, t, e, window_weight({words.word(x) for x in range(a, b) if x != k}, q, e)))
    return out, words.count


def form_of(word: str, term: str, edits: int) -> str:
    """What a hit is counted as: the term itself, or the word with an edit ("~"), in both cases behind the term; of a stem only whether it was edited."""
    return f"{term}~{'' if term.endswith('*') else word}" if edits else f"{term}="


def found_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: tuple[str, ...] = tuple(LEXICON)) -> DataFrame:
    """(id, words, forms, weights) of every row's whole text: each hit's form (form_of) and window weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon)
        for batch in batches:
            sizes, words = [np.zeros(1, np.int64)], []
            forms: list[str] = []
            weights: list[float] = []
            for texts in common.text_runs(batch.column(1)):
                found, count = hits(texts, machine)
                sizes.append(np.bincount(np.array([h[0] for h in found], np.int64), minlength=len(texts)))
                words.append(count)
                forms += [form_of(h[1], lexicon[h[2]], h[3]) for h in found]
                weights += [h[4] for h in found]
            if words:
                offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
                yield pa.record_batch([batch.column(0), pa.array(np.concatenate(words).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(forms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64()))], ["id", "words", "forms", "weights"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, words long, forms array<string>, weights array<double>")


_RUN = re.compile(r"[^\W\d_]+")


def _stems(text: str) -> set[str]:
    """Beginnings of the words of a text."""
    return {w[:n] for w in set(_RUN.findall(text.lower())) for n in STEM if len(w) >= n}


def _mark(text: str) -> int:
    """The same for copies of a text, as a rule: its smallest hash of three words in a row."""
    w = [crc32(x.encode("utf-8", "replace")) for x in _RUN.findall(text.lower())]
    return min((crc32(b"%d %d %d" % t) for t in zip(w, w[1:], w[2:])), default=0)


def chance(a: int, b: int, share: float) -> float:
    """The probability that of a + b texts at least a are toxic, if each is with probability `share`."""
    n = a + b
    top = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log1p(-share) for k in range(a, n + 1)]
    return min(1.0, sum(exp(x) for x in top))


def learn_stems(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Stems (with "*") that mark toxic documents among training(id, y), which has TRAINING_ROWS rows at most, the surest first."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(training), "id").where("text IS NOT NULL")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([_mark(t) for t in batch.column(1).to_pylist()], pa.int64())], ["y", "text", "mark"])

    # Copies of one text are no evidence of their own: texts of one label and mark count once.
    known = common.cut(texts.select("y", "text").mapInArrow(marked, "y int, text string, mark long").dropDuplicates(["y", "mark"]))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []

    def counted(y: int, wanted: frozenset[str] | None):
        starts = wanted and {s[: STEM[0]] for s in wanted}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    if wanted is None:
                        seen.update(_stems(t))
                    else:
                        near = {w for w in set(_RUN.findall(t.lower())) if w[: STEM[0]] in starts}
                        seen.update({w[:k] for w in near for k in STEM if len(w) >= k} & wanted)
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["stem", "n"])

        return known.where(F.col("y") == y).select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    # A stem of fewer toxic texts than this would be chance even if no other text had it. What is left has no more rows than the
    # sample's texts have such stems.
    share = n[1] / (n[0] + n[1])
    of_toxic = common.cut(counted(1, None))
    tried = of_toxic.count()
    toxic = {r.stem: r.n for r in of_toxic.where(F.col("n") >= max(2, ceil(log(1e-2) / log(share)))).collect()}
    clean = {r.stem: r.n for r in counted(0, frozenset(toxic)).collect()} if toxic else {}
    odds = {s: ((a + 0.5) / (n[1] + 1)) / ((clean.get(s, 0) + 0.5) / (n[0] + 1)) for s, a in toxic.items()}
    by_chance = sorted((chance(a, clean.get(s, 0), share), -len(s), s) for s, a in toxic.items() if odds[s] >= LIKELIER)
    # Benjamini and Hochberg: as many as keep the expected share of false ones.
    most = max((k for k, (p, _, _) in enumerate(by_chance, 1) if p <= FALSE_SHARE * k / tried), default=0)
    out: list[str] = []
    taken: set[str] = set()  # the stems taken, and all beginnings of them
    for _, _, s in by_chance[:most]:
        if s not in taken and not any(s[:k] in out for k in STEM if k < len(s)):
            out.append(s)
            taken.update(s[:k] for k in range(1, len(s) + 1))
            if len(out) == LEARNED:
                break
    return [f"{s}*" for s in out]


def trust(seen: list[tuple[str, int, int]], base: float) -> tuple[dict[str, float], dict[str, float]]:
    """How far each form speaks for toxicity, from 0 to 1, by (form, training documents with it, toxic ones of these); and how far each
    term does, plain ("term=") or edited ("term~"), for forms that training has not seen.

    Words of ordinary language that lie within an edit of a term, or are spelled like one, lose their weight so.
    """
    scaled = lambda x: min(1.0, max(0.0, (x - base) / max(1e-9, 1 - base)))
    group = lambda f: f[: re.search("[=~]", f).end()]
    total: dict[str, list[int]] = {}
    for form, n, toxic in seen:
        own = total.setdefault(group(form), [0, 0])
        own[0] += n
        own[1] += toxic
    prior = {g: (t + p * s) / (n + s) for g, (n, t) in total.items() for p, s in [UNSEEN[g[-1]]]}
    forms = {form: scaled((toxic + prior[group(form)] * UNSEEN[group(form)[-1]][1]) / (n + UNSEEN[group(form)[-1]][1])) for form, n, toxic in seen}
    return forms, {g: scaled(p) for g, p in prior.items()} | {k: scaled(p) for k, (p, _) in UNSEEN.items()}


#: Prior of a plain and of an edited form to be toxic, and how many documents it is worth.
UNSEEN = {"=": (0.95, 2), "~": (0.5, 1)}


def weighed_sum(forms: list[str], weights: list[float], trusted: dict[str, float], unseen: dict[str, float]) -> float:
    """Evidence of a text's hits; one form counts twice at most, however often it is repeated."""
    own: dict[str, tuple[float, float]] = {}
    for f, w in zip(forms, weights):
        most, total = own.get(f, (0.0, 0.0))
        own[f] = (max(most, w), total + w)

    def worth(f: str) -> float:
        if f in trusted:
            return trusted[f]
        g = f[: re.search("[=~]", f).end()]
        return unseen.get(g, unseen[g[-1]])

    return sum(min(2 * most, total) * worth(f) for f, (most, total) in own.items())


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.minimum(np.log1p(weight), 2.5), np.minimum(np.sqrt(weight / np.maximum(words, 5)), 0.5)], 1)


#: Weights without training rows, and centre of the penalty on the slopes.
_PRIOR = np.array([-3.0, 5.0, 2.0])


def fit(rows: list[tuple[float, int, int]], penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on (evidence, words, y); slopes are held near fixed ones by the penalty and never negative."""
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return _PRIOR.copy()
    x = _features(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))
    w, hold = _PRIOR.copy(), np.diag([1e-3, penalty, penalty])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ (w - _PRIOR))
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) for every row of docs."""
    common.prepare(docs.sparkSession)
    sample = common.cut(common.bounded_sample(stats.training_labels(labels, label, id_col), "id", TRAINING_ROWS))
    learned = learn_stems(docs, sample, id_col, text_col)
    found = common.cut(found_hits(docs, id_col, text_col, tuple(dict.fromkeys([*LEXICON, *learned]))))
    # One row an id, whatever the table repeats, so that no more rows than the sample has are learned from.
    training = common.cut(found.join(F.broadcast(sample), "id").dropDuplicates(["id"]))
    # No more forms than the automaton accepts, whatever the size of the corpus.
    seen = training.select("y", F.explode(F.array_distinct("forms")).alias("form")).groupBy("form").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).collect()
    base = training.agg(F.avg("y")).first()[0]
    trusted, unseen = trust([tuple(r) for r in seen], base or 0.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, weights = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            total = [weighed_sum(a, b, trusted, unseen) for a, b in zip(forms, weights)]
            yield pa.record_batch([batch.column(0), pa.array([len(a) for a in forms], pa.int64()), pa.array(total, pa.float64()), batch.column(1), *batch.columns[4:]], ["id", "hits", "evidence", "words", *batch.schema.names[4:]])

    weighed = "id long, hits long, evidence double, words long"
    known = training.select("id", "words", "forms", "weights", "y").mapInArrow(weigh, f"{weighed}, y int")
    w = fit(sorted((r.evidence, r.words, r.y) for r in known.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.round(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 9))], ["id", "n_hits", "score"])

    scored = found.mapInArrow(weigh, weighed).mapInArrow(run, "id long, n_hits long, score double")
    return scored.select(F.col("id").alias("doc_id"), stats.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
