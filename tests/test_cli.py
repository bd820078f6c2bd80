"""The command line from files to answers."""

import json

import pytest

from querylark import cli

TEXTS = {
    "a.txt": "Stockholm is the capital of Sweden. It is located in the east of the country.",
    "b.txt": "A database stores tables. The database is used in many applications.",
    "c.txt": "Firewalls protect networks from malware and other dangers.",
    "empty.txt": "",
}


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    (at / "data").mkdir()
    for name, text in TEXTS.items():
        (at / "data" / name).write_text(text)
    assert cli.main(["ingest", str(at / "data"), str(at / "index")]) == 0
    return at


def said(capsys, *args):
    capsys.readouterr()
    assert cli.main([str(a) for a in args]) == 0
    return capsys.readouterr().out.strip()


def test_hybrid_takes_vectors_once_they_are_built(place, capsys):
    plain = json.loads(said(capsys, "hybrid", place / "index", "database tables"))
    assert [r["doc"] for r in plain["results"]] == [2] and "database" in plain["summary"]
    said(capsys, "build", place / "index")
    both = json.loads(said(capsys, "hybrid", place / "index", "database tables"))
    scores = {r["doc"]: r["score"] for r in both["results"]}
    # Every document is near enough to be among the nearest; the only one with the words has the whole lexical share.
    assert set(scores) == {1, 2, 3} and 0.85 <= scores[2] <= 1.0 and max(scores[1], scores[3]) <= 0.3
    (place / "lexical.conf").write_text("retrieval.bm25_weight = 1\nretrieval.ann_weight = 0\n")
    alone = json.loads(said(capsys, "hybrid", place / "index", "database tables", "--config", place / "lexical.conf"))
    assert {r["doc"]: r["score"] for r in alone["results"]} == {1: 0.0, 2: 1.0, 3: 0.0}
    # Written anew, an index has no vectors.
    cli.main(["ingest", str(place / "data"), str(place / "index")])
    assert json.loads(said(capsys, "hybrid", place / "index", "database tables"))["results"] == plain["results"]


def test_memory_goes_on_from_call_to_call(place, capsys):
    memory = place / "memory"
    first = said(capsys, "ask", place / "index", "Where is Stockholm located?", "--memory", memory)
    assert "Stockholm" in first
    again = said(capsys, "ask", place / "index", "Where is it?", "--memory", memory)
    assert "Stockholm" in again
    said(capsys, "ask", place / "index", "What is a database used for?", "--memory", memory)
    assert "database" in said(capsys, "ask", place / "index", "What is it used for?", "--memory", memory)
    assert "Stockholm" not in said(capsys, "ask", place / "index", "Where is it?")


def test_settings_take_effect(place, capsys):
    (place / "short.conf").write_text("scope.strict_max_chars = 20\nscope.normal_max_chars = 20\nscope.expanded_max_chars = 20\nretrieval.retriever = bm25\n")
    answer = said(capsys, "ask", place / "index", "Where is Stockholm located?", "--config", place / "short.conf").splitlines()[0]
    assert 0 < len(answer) <= 23
    (place / "bad.conf").write_text("retrieval.retriever = best\n")
    with pytest.raises(ValueError):
        cli.main(["ask", str(place / "index"), "Where?", "--config", str(place / "bad.conf")])
