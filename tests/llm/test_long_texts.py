"""One text of 20 MB among short ones: right results, and memory in a small proportion to it."""

import hashlib
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from lodemill.llm import near_dup, quality_rules, suffix_dedup, textblock

MB = 20


def _text(seed=0, size=MB << 20):
    rng = np.random.default_rng(seed)
    words = np.array([bytes(rng.integers(97, 123, int(k)).astype(np.uint8)) for k in rng.integers(2, 10, 5000)], object)
    return b" ".join(words[rng.zipf(1.3, size // 5) % 5000])[:size].decode()


def _peak(code):
    """MB that a process takes for the code beyond what it has with the text made."""
    head = "import sys; sys.path[:0] = ['tests/llm', '.']\nimport resource, pyarrow as pa, numpy as np\nfrom test_long_texts import _text\nfrom lodemill.llm import near_dup, quality_rules, suffix_dedup, textblock\n"
    body = "block = textblock.TextBlock(pa.array([_text()]))\nblock.hashes(np.array([0]), np.array([9]))\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
    out = subprocess.run([sys.executable, "-c", f"{head}{body}{code}\nprint('MB', (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"], capture_output=True, text=True, check=True)
    return int(out.stdout.split("MB")[-1])


@pytest.mark.parametrize(
    "code, most",
    [
        ("quality_rules.rule_counts(block)", 40 * MB),
        ("quality_rules.Names(1 << 30).grams(block)", 25 * MB),
        ("near_dup.shingles(block)", 25 * MB),
        ("suffix_dedup._segments(block, 100, 24)", 25 * MB),
    ],
    ids=["rules", "grams", "shingles", "segments"],
)
def test_memory_of_a_long_text(code, most):
    assert _peak(code) < most


def test_a_long_block_hashes_like_short_ones():
    raw = _text(1, 5 << 20)
    whole = textblock.TextBlock(pa.array([raw]))
    rng = np.random.default_rng(2)
    starts = np.sort(rng.integers(0, len(raw) - 4 * textblock.PART // 2 - 9, 300))
    ends = starts + np.append(rng.integers(0, 5000, 298), [textblock.PART + 77, 2 * textblock.PART])
    found = whole.hashes(starts, ends)
    for a, b, h in zip(starts.tolist(), ends.tolist(), found.tolist(), strict=True):
        part = textblock.TextBlock(pa.array([raw[a:b]]))
        n = np.array([len(part.data)])
        assert int((part.hashes(np.array([0]), n) if n[0] <= textblock.PART else [part._long(0, int(n[0]))])[0]) == h
    shuffled = rng.permutation(300)
    assert (whole.hashes(starts[shuffled], ends[shuffled]) == found[shuffled]).all()
    # A long range is hashed by parts as by one sum.
    s = textblock._sums(whole.data)
    bits = textblock._bits(len(whole.data))
    assert (textblock.mix((s[ends] - s[starts]) * textblock._powers(bits)[1][starts]) == found).all()


def test_a_long_text_and_its_copies(spark):
    long = _text(3, 6 << 20)
    near = long[: 5 << 20] + " and something else " + long[5 << 20 :]
    rows = [(1, "a short one of a few words"), (2, long), (3, long), (4, near), (5, long[1 << 20 : 2 << 20])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.doc_id: (r.class_id, r.n_copies) for r in near_dup.near_duplicates(df)[0].collect()}
    assert classes[2] == classes[3] == (2, 1) and classes[4] == (2, 0) and classes[1] == (1, 0)
    out = {r.doc_id: r for r in suffix_dedup.drop_repeats(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[3].kept_sha256 == out[5].kept_sha256 == empty and out[3].n_removed == len(long.encode())
    # What was put in stays, but for the bytes at its ends that equal strings of the text may cover.
    assert 0 < out[4].n_bytes - out[4].n_removed <= 20
    rules = {r.doc_id: r for r in quality_rules.quality_rules(df, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()}
    assert rules[2].n_words == len(long.split()) and rules[2].word_chars == sum(map(len, long.split()))
