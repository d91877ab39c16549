import json
import random
import tracemalloc

import numpy as np

from tarnwork.llm.leakage import common_runs, leaked_passages, tiles
from tarnwork.llm.notebooks import words


def test_words_of_layouts():
    want = "the copper barge was rinsed".split()
    book = {"cells": [{"cell_type": "code", "source": ["# the cop​per\n", "# *barge*"], "outputs": []}, {"cell_type": "markdown", "source": ["_was_ rinsed"]}]}
    for text in (json.dumps(book), json.dumps(book, ensure_ascii=False, indent=1), "# %% [markdown]\n# The copper\n\n# %% In[3]\n# barge was\n# output: stream\n# rinsed", "In [3]: # the copper\n   ...: # barge was\n\nIn [ ]: rinsed", "```python\nThe co​pper\n```\n> barge_was rinsed"):
        assert words(text) == want
    assert words(None) == words("") == [] and words('{"cells": [ "broken\\n"')[:2] == ["cells", "broken"]


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_tiles_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        item = np.array([rnd.randrange(1, 6) for _ in range(40)])
        doc = np.array([rnd.randrange(0, 6) for _ in range(30)] + list(item[20:33]) + [0] + list(item[2:19]) + list(item[20:33]))
        longest, marked = tiles(item, doc, 4)
        assert longest == longest_common(item.tolist(), [x if x else -1 for x in doc.tolist()])
        used_i, used_d = set(), set()
        for n, i, j in marked:
            assert n >= 4 and (item[i : i + n] == doc[j : j + n]).all()
            assert not used_i & set(range(i, i + n)) and not used_d & set(range(j, j + n))
            used_i |= set(range(i, i + n))
            used_d |= set(range(j, j + n))
        assert sum(n for n, _, _ in marked) >= 26
    assert tiles(np.array([1, 2]), np.array([1, 2]), 4) == (0, [])


def test_leaks(spark):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=30)), " ".join(rnd.choices(vocabulary, k=5)) if i else None) for i in range(6)] + [(6, "", None)]
    docs = []
    for i in range(60):
        body = rnd.choices(vocabulary, k=rnd.randrange(0, 50))
        _, prompt, answer = rnd.choice(items[1:6])
        p = prompt.upper().split()
        body += rnd.choice([p[:13], p[5:17], p[15:] + p[:15], answer.split(), []]) + rnd.choices(vocabulary, k=4)
        docs.append((i, ",\n".join(body), i))
    docs += [(100, None, 1), (101, "", 1), (7, docs[7][1], 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    t = spark.createDataFrame(items, "item_id bigint, prompt string, answer string")
    for block in (1000, 20):
        got = {(r.doc_id, r.item_id, r.part): r for r in leaked_passages(d, "doc_id", "text", t, "item_id", ["prompt", "answer"], 8, block).collect()}
        want = {}
        for key, body, _ in docs:
            for item, *parts in items:
                for name, part in zip(("prompt", "answer"), parts):
                    w = (part or "").split()
                    n = longest_common(w, words(body)) if w and body else 0
                    if w and n >= min(8, len(w)):
                        want[key, item, name] = n
        assert {k: r.longest_run for k, r in got.items()} == want
    assert any(r.coverage == 1.0 and r.tiles == 2 for r in got.values())
    assert leaked_passages(d.limit(0), "doc_id", "text", t, "item_id", ["prompt"]).count() == 0
    assert leaked_passages(d, "doc_id", "text", t.limit(0), "item_id", ["prompt"]).count() == 0


def test_runs_go_on_from_lot_to_lot():
    rnd = random.Random(8)
    for _ in range(40):
        item, doc = (np.array([rnd.randrange(0, 3) for _ in range(n)]) for n in (25, 70))
        want = {tuple(r) for r in common_runs(item, doc, 3).tolist()}
        assert want == {tuple(r) for r in common_runs(item, doc, 3, at_once=5).tolist()} and len(want) == len(common_runs(item, doc, 3, at_once=1))
        longest = longest_common([x or -1 for x in item.tolist()], [x or -2 for x in doc.tolist()])
        assert max((n for n, _, _ in want), default=0) == (longest if longest >= 3 else 0)


def test_one_word_over_and_over_takes_little_memory():
    tracemalloc.start()
    longest, marked = tiles(np.ones(200, np.int64), np.ones(40_000, np.int64), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert longest == 200 and marked == [(200, 0, 0)] and peak < 200e6
    doc = np.array([1, 1, 1, 2] * 10_000)
    assert tiles(np.array([1, 1, 1, 2] * 50), doc, 8)[0] == 200


def test_a_seed_in_every_document(spark):
    d = spark.range(2000).selectExpr("id as doc_id", "concat('one two three four five six seven eight nine ten ', if(id % 100 = 0, 'eleven twelve thirteen', 'other')) as text")
    t = spark.createDataFrame([(i, "one two three four five six seven eight nine ten eleven twelve thirteen" if i == 0 else f"one two three four five six seven eight item{i}") for i in range(5)], "item_id int, prompt string")
    got = leaked_passages(d, "doc_id", "text", t, "item_id", ["prompt"])
    assert got.count() == 10_000 and got.where("longest_run >= 13").count() == 20
