import functools
import random

import numpy as np
from querylark.llm import common, toxicity


def edits(a, b):
    """Edit distance with exchanges of neighbours (each letter touched once)."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def accepted(words, machine):
    own = toxicity.Words([" ".join(words)], machine)
    w, term, e = toxicity.match(own, machine)
    assert own.count.tolist() == [len(words)]
    return {own.word(k): x for k, x in zip(w.tolist(), e.tolist())}


def test_automaton_equals_edit_distance():
    terms = ("abcab", "abba", "bacabc", "ccccc", "abaé")
    r = random.Random(2)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(4000)]
    want = {}
    for w in set(words):
        best = min((edits(w, t) for t in terms if len(t) >= toxicity.FUZZY or w == t), default=9)
        if best <= 1:
            want[w] = best
    assert accepted(words, toxicity.automaton(terms)) == want


def test_stems_accept_all_that_follows():
    terms = ("abcab*", "ab*", "bacabc")
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 10))) for _ in range(4000)]
    want = {}
    for w in set(words):
        own = [edits(w, "bacabc"), *(min(edits(w[:k], "abcab") for k in range(len(w) + 1)),), 0 if w.startswith("ab") else 9]
        if min(own) <= 1:
            want[w] = min(own)
    assert accepted(words, toxicity.automaton(terms, 5, 5)) == want


def test_letters_of_any_script_are_told_apart():
    machine = toxicity.automaton((*toxicity.LEXICON, "слово"))
    assert accepted(["книга", "стоит", "СЛОВО", "словa", "62869", "汉字汉字汉", "слооо"], machine) == {"слово": 0, "словa": 1, "слооо": 1}


def hits(text):
    return [(h[1], h[3], h[4]) for h in toxicity.hits([text], toxicity.automaton(tuple(toxicity.LEXICON)))[0]]


def test_misspellings_quotation_and_ordinary_words():
    assert hits("You are an IDIOT, a m0ron, an idoit!") == [("idiot", 0, 1.25), ("m0ron", 0, 1.25), ("idoit", 1, 0.7 * 1.25)]
    assert hits('He said that "idiot" is an insult.') == [("idiot", 0, 0.25)]
    assert hits("The crown was lower and closer to the crash.") == []
    assert hits("") == []
    assert hits('a "quoted moron"\nidiot "') == [("moron", 0, 0.25), ("idiot", 0, 1.0)]
    assert hits('"' + "far " * 500 + 'moron" now') == [("moron", 0, 0.25)]
    found, count = toxicity.hits(["", "an idiot", "x", "you scum"], toxicity.automaton(tuple(toxicity.LEXICON)))
    assert [(h[0], h[1], h[4]) for h in found] == [(1, "idiot", 1.0), (3, "scum", 1.25)] and count.tolist() == [0, 2, 1, 2]


def test_held_out_accuracy_and_edges(spark):
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.01").join(common.read(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.93
    rows = [(1, None), (2, ""), (3, "you worthless pathetic idiot"), (4, "a fine day " * 30000), (None, "scum"), (3, "you worthless pathetic idiot")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.scores(docs, labels).collect()}
    assert out[3] == 1 and not (out[1] or out[2] or out[4]) and len(out) == 5
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_terms_are_learned_from_labels(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeoulmnz") for _ in range(r.randrange(8, 12)))
    rows = [(i, " ".join([word() for _ in range(30)] + (["zorblatt"] if i % 4 == 0 else []) + [word() for _ in range(30)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.learn_stems(docs, toxicity.stats.training_labels(labels, "toxic")) == ["zorblatt*"]
    assert all(x.predicted == (x.doc_id % 4 == 0) for x in toxicity.scores(docs, labels).collect())


def test_forms_that_training_has_not_seen():
    forms, unseen = toxicity.trust([("idiot=", 18, 18), ("clown~crowns", 10, 0), ("lowei*~", 4, 1)], 0.1)
    assert forms["idiot="] > 0.9 and forms["clown~crowns"] < 0.1
    assert unseen["clown~"] < 0.1 < unseen["~"] < 0.5 < unseen["="] < 1.0 and unseen["idiot="] > unseen["="]
    assert toxicity.weighed_sum(["moron=", "clown~clowm", "moron~morn"], [1.0, 1.0, 1.0], forms, unseen) == unseen["="] + unseen["clown~"] + unseen["~"]


def test_scores_equal_a_plain_version(spark):
    """Evidence, words and the regression of each document, by strings and loops."""
    import math
    import re

    d = "/root/testdata/sf0.001"
    docs, labels = common.read(spark, d, "documents"), common.read(spark, d, "labels")
    known = {r.id: r.y for r in toxicity.stats.training_labels(labels, "toxic").collect()}
    stems = toxicity.learn_stems(docs, toxicity.stats.training_labels(labels, "toxic"))
    terms = [*toxicity.LEXICON, *stems]
    fold = str.maketrans(toxicity._STANDS_FOR)

    @functools.lru_cache(maxsize=None)
    def best_term(w):
        best = (9, 9, "")
        for at, t in enumerate(terms):
            if t.endswith("*"):
                e = 0 if w.startswith(t[:-1]) else min(edits(w[:j], t[:-1]) for j in range(len(t) - 2, min(len(w), len(t)) + 1)) if len(t) > toxicity.FUZZY_STEM and len(w) >= len(t) - 2 else 9
            else:
                e = 0 if w == t else edits(w, t) if len(t) >= toxicity.FUZZY and abs(len(w) - len(t)) < 2 and len(set(w) ^ set(t)) < 3 else 9
            best = min(best, (e, at, t))
        return best

    evidence = {}
    for r in docs.collect():
        found, n = [], 0
        for line in (r.text or "").split("\n"):
            words = list(re.finditer(r"(?:[^\W_]|[@$])+", line))
            n += len(words)
            for k, m in enumerate(words):
                raw = m[0].lower()
                e, _, t = best_term(raw.translate(fold))
                if e > 1 or e and raw in toxicity.ORDINARY:
                    continue
                near = {x[0].lower() for x in words[max(0, k - 8) : k] + words[k + 1 : k + 9]}
                marks = [x.start() for x in re.finditer("[\"“”„«»]", line)]
                before = sum(x < m.start() for x in marks)
                quoted = before % 2 == 1 and before < len(marks) or bool(near & toxicity._REPORT)
                weight = (0.7 if e else 1.0) * (0.25 if quoted else 1.25 if near & toxicity._SECOND else 1.0)
                found.append((t + ("~" + ("" if t.endswith("*") else raw) if e else "="), weight))
        evidence[r.doc_id] = found, n
    own = [i for i in known if i in evidence]
    base = sum(known[i] for i in own) / len(own)
    count = {}
    for i in own:
        for f in {f for f, _ in evidence[i][0]}:
            c = count.setdefault(f, [0, 0])
            c[0] += 1
            c[1] += known[i]
    forms, unseen = toxicity.trust([(f, *c) for f, c in count.items()], base)
    total = {i: (toxicity.weighed_sum([f for f, _ in x], [w for _, w in x], forms, unseen), n) for i, (x, n) in evidence.items()}
    w = toxicity.fit(sorted((*total[i], known[i]) for i in own))
    for r in toxicity.scores(docs, labels).collect():
        e, n = total[r.doc_id]
        z = w @ [1, min(math.log1p(e), 2.5), min(math.sqrt(e / max(n, 5)), 0.5)]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6, r
