"""Ranked search, line dedup and the filter audit against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import filter_audit, lexical, line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta gamma\n" * 30000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one long line here\n\nx"), (5, "One long line here \ntwo"), (6, LONG), (7, "é ü 你好  x\n ÉÉÉÉÉÉÉÉÉÉ"), (8, "A b # C d E f"), (8, "A b # C d E f"), (None, "one long line here\nnull id"), (9, "\n\n\n")]
SCHEMA = "doc_id long, text string, source string, id long, t long, lines string, term string, n long, keep int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s" if i != 4 else None, 1, 2, "", "", 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 1), (None, 1, 1), (8, 0, None), (8, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus():
    """Texts from few words, with copies, frequent lines and ties."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Häuser", "x#y", "WORD"]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 14)))
    common = [line() for _ in range(6)]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.3 else line() for _ in range(rng.randrange(1, 12))) for _ in range(250)]
    texts += [texts[3]] * 60 + [common[0] + "\n" + common[0]] * 30
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + ODD


def brute_search(docs, items, top=20):
    terms = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_all, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_all) // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, -1 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return out


@pytest.mark.parametrize("p", [lexical.SearchParams(), lexical.SearchParams(fan_out=2, block_documents=8, block_postings=300, nodes_first=1, chunk_items=2, upper_shift=1, filter_bits=10)])
def test_ranked_search(spark, corpus, p):
    """Exact, ties included, with one block and with many small blocks under several levels."""
    items = [(1, "w1 W2 w2 häuser"), (2, "w5 nothing"), (3, ""), (4, None), (5, "nothing"), (6, " ".join(f"w{i}" for i in range(60))), (7, "alpha beta"), (None, "x y word")]
    asked = spark.createDataFrame([(i, t, 5) for i, t in items + items[:1]], "item_id long, text string, q int")
    found = lexical.search(frame(spark, corpus), asked, p).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or -1)
    assert sorted(map(tuple, found), key=key) == sorted(brute_search(corpus, items), key=key)


def test_search_tables_empty_or_odd(spark):
    odd, items = frame(spark, ODD), spark.createDataFrame([(1, "one x alpha null")], "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.search(odd, items).collect()) == sorted(brute_search(ODD, [(1, "one x alpha null")]))
    assert lexical.search(odd.limit(0), items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_max_tree_bounds():
    """Each node's maxima are those of the documents under it, whatever the number of documents."""
    rng = np.random.default_rng(2)
    for n in (1, 15, 16, 17, 300):
        table = rng.integers(0, 50, (n, 12)) * (rng.random((n, 12)) < 0.4)
        document, term = np.nonzero(table)
        for level, (starts, terms, parts) in enumerate(lexical.max_tree(document, term, table[document, term], n, 16)):
            for node in range(len(starts) - 1):
                under = table[node * 16**level : (node + 1) * 16**level].max(axis=0)
                assert dict(zip(terms[starts[node] : starts[node + 1]].tolist(), parts[starts[node] : starts[node + 1]].tolist())) == {i: x for i, x in enumerate(under.tolist()) if x}


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute_lines(docs):
    first = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            k, at = line_key(line), math.inf if i is None else i
            if len(k) >= 10:
                first[k] = min(first.get(k, math.inf), at)
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or first[line_key(x)] == (math.inf if i is None else i)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("p", [line_dedup.LineParams(), line_dedup.LineParams(hot_keys=2, tracked=64)])
def test_line_dedup(spark, corpus, p):
    """Whether keys are looked up or streamed, the lines that stay are those of brute force."""
    docs = corpus + [(900 + i, "\n".join(f"a long line number {j}" for j in range(i, 200, 7))) for i in range(20)]
    found = line_dedup.dedup_lines(frame(spark, docs), p).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, found)) == Counter(brute_lines(docs))
    assert line_dedup.dedup_lines(frame(spark, docs).limit(0), p).count() == 0


def test_keep_bitmaps_are_small(spark):
    """Only documents that lose a line have a bitmap, and its words end with the last line lost."""
    docs = [(1, "the very first line"), (2, "\n" * 200 + "The very first line" + "\nother" * 500)]
    rows = line_dedup.keep_bitmaps(frame(spark, docs)).collect()
    assert [(r.id, r.n_dropped, len(r.keep)) for r in rows] == [(2, 1, 4)]
    assert [x for x in rows[0].keep if x != -1] == [~(1 << 200 % 64)]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    smallest = defaultdict(lambda: math.inf)
    for i, text, _ in docs:
        smallest[text or ""] = min(smallest[text or ""], math.inf if i is None else i)
    rows = defaultdict(list)
    for i, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * upper > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": smallest[text] < (math.inf if i is None else i)}
        rows[part or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    for part, held in rows.items():
        removed_in = Counter()
        result = []
        for order in filter_audit.ORDERS:
            left = list(held)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                earlier = sum(letter in x[0] for x in held) - len(gone)
                left = [x for x in left if letter not in x[0]]
                removed_in[letter] += len(gone)
                result.append([part, order, step, len(left), len(gone), earlier, sum(x[0] == {letter} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone), letter])
        yield from ((*r[:-1], removed_in[r[-1]]) for r in result)


def test_filter_audit(spark, corpus, labels):
    rows = [(i, t, None if n % 5 == 0 else "abc"[n % 3]) for n, (i, t) in enumerate(corpus)]
    rows += [(2000 + n, " ".join(f"Y{j % (20 + n)}" for j in range(60)), "a") for n in range(40)]
    told = [(6, 1, 0), (7, 1, 1), (None, 1, 1), (8, 0, None), (8, 1, 1)] + [(i, i % 2, int(i % 3 == 0)) for i in range(10, 2040, 4)]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, source string, mask int, same binary")
    marks = spark.createDataFrame([(*r, "x") for r in told], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.filter_audit(docs, marks).collect()
    assert sorted(map(tuple, found)) == sorted(brute_audit(rows, told))
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(docs.limit(3), marks.limit(0)).count() == 600 * docs.limit(3).select("source").distinct().count()


def test_parity_sums_invert():
    cells = np.random.default_rng(1).integers(0, 10**12, (4, 32))
    sums = np.array([[sum(int(c) * (-1) ** bin(m & s).count("1") for m, c in enumerate(row)) for s in range(32)] for row in cells])
    assert (filter_audit.cells_of(sums) == cells).all()


def test_text_masks_of_chunks():
    """A text's mask does not depend on the texts beside it."""
    texts = [None, "", "A B", "x " * 60, "word# " * 3, " ".join(map(str, range(50))), "Ä" * 10 + "A"]
    alone = [filter_audit.text_masks([t])["mask"][0].as_py() for t in texts]
    assert filter_audit.text_masks(texts)["mask"].to_pylist() == alone
    assert filter_audit.text_masks(["b"])["same"][0].as_py() == hashlib.sha256(b"b").digest()[:16]
