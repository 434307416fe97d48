import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixmill.llm import fill_middle
from helixmill.llm.fill_middle import Fenwick, MiddleParams, cut_texts
from .helpers import awkward, docs, rows_of

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(output), sha(text))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = awkward() + [(100 + k, "".join(rng.choice("ab cD<>PSM9é漢\U0001f600\n\0'") for _ in range(rng.choice((1, 3, 40, 255, 256, 257, 900))))) for k in range(200)]
    rows += [(400, "x<P>y"), (401, "<" * 700), (402, "a" * 3000), (403, "tail <M>"), (404, "<S"), (405, "P>"), (406, "\r\n\r\n")]
    frame = fill_middle.digest_rearranged(docs(spark, rows, clashing=True))
    got = rows_of(frame, *COLUMNS)
    key = lambda r: tuple((x is None, x) for x in r)
    assert got == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_restore(spark):
    frame = fill_middle.rearrange(docs(spark))
    again = frame.select("text", fill_middle.restored(frame["output"], frame["form"]).alias("back"), "output", "form").collect()
    assert all(r.text == r.back for r in again)
    assert all(r.output == r.text for r in again if r.form == "plain") and any(r.output != r.text for r in again)


def test_empty_table(spark):
    frame = fill_middle.digest_rearranged(docs(spark, []))
    assert frame.columns == list(COLUMNS) and frame.count() == 0


def test_block_size_changes_nothing(spark):
    frame = docs(spark)
    small = fill_middle.digest_rearranged(frame, MiddleParams(block=3))
    assert rows_of(small, *COLUMNS) == rows_of(fill_middle.digest_rearranged(frame), *COLUMNS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ \n<é\U0001f600", max_size=40), max_size=12), st.integers(1, 9), st.data())
def test_cuts(found, block, data):
    first = np.array([data.draw(st.integers(0, 2**32 - 1)) for _ in found], np.int64)
    second = np.array([data.draw(st.integers(0, 2**32 - 1)) for _ in found], np.int64)
    n, prefix, middle = cut_texts(found, first, second, block)
    for i, text in enumerate(found):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((int(first[i]) % (len(units) + 1), int(second[i]) % (len(units) + 1)))
        assert (n[i], prefix[i], middle[i]) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=70))
def test_fenwick(values):
    tree, sums = Fenwick(np.array(values), np.ones(len(values), np.int64)), np.concatenate(([0], np.cumsum(values)))
    assert tree.before(np.arange(len(values) + 1))[0].tolist() == sums.tolist()
    targets = np.arange(sums[-1])
    at, (units, chars) = tree.descend(targets)
    for t, a, u, c in zip(targets, at, units, chars):
        assert sums[a] <= t < sums[a + 1] and u == sums[a] and c == a
