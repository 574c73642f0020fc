"""Each stage is held against a brute-force version of it on the stage's own input."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import test_neardup  # noqa: E402

from strata.llm.common import cut  # noqa: E402
from strata.llm.queries import tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_copies", "near_copies", "mixture", "packed"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            lettered = {r.doc_id for r in given if r.text and any(map(str.isalpha, r.text))}
            assert {r.doc_id for r in got} <= lettered and len(got) >= 0.98 * len(lettered)
        elif name == "exact_copies":
            last = {}
            for r in given:
                key = hashlib.sha256((r.text or "").encode().lower()).digest()
                last[key] = max(last.get(key, -1), r.doc_id)
            assert sorted(r.doc_id for r in got) == sorted(last.values())
        elif name == "near_copies":
            want = test_neardup.brute([(r.doc_id, r.text) for r in given], 5)
            assert sorted(r.doc_id for r in got) == [d for d, _, c in want if d == c]
        else:
            copies = Counter(r.doc_id for r in got)
            assert set(copies) == {r.doc_id for r in given} and max(copies.values()) <= 2
        given = got
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = sum(len(full.encode(r.text, add_special_tokens=False).ids) + 1 for r in given)
    assert sum(p.length for p in pieces) == want == sum(p.doc_tokens for p in pieces if p.start == 0)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert np.isclose(sum(p.length for p in whole), want) and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_any_columns_and_rows(spark):
    """Columns with the names that the operators use inside; null, empty, very long and repeated rows; an empty table."""
    names = ["kept", "row", "digest", "h", "place", "block", "copies", "epoch", "mix_order", "mix_epoch", "mix_weight", "language", "salt", "same", "bands", "class", "first", "shard", "a.b", "Kept2"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    long = " ".join(f"word{i}" for i in range(60_000))
    texts = [(1, "the same words in a row again and again"), (1, "the same words in a row again and again"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long + " end"), (None, "a text without an id but with words"), (7, "The SAME words in a row again and again"), (8, "漢字 仮名 漢字 仮名 漢字"), (9, "another text that stays as it is")]
    rows = [(d, t, "en" if t and t.isascii() else None, None if d == 9 else "s", 1, *[f"{n} of {i}" for n in names]) for i, (d, t) in enumerate(texts)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            got = sorted(out.collect(), key=str)
            assert all(tuple(r) in {tuple(x) for x in given} for r in got), name
            if name == "language":
                assert {r.doc_id for r in got} == {d for d, t in texts if t and t.strip() and t.isascii()} if given else not got
            elif name == "exact_copies":
                assert sorted(str(r.doc_id) for r in got) == sorted(["3", "4", "5", "6", "7", "8", "9", "None"] if given else [])
            elif name == "near_copies":
                assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "2", "3", "4", "5", "8", "9", "None"] if given else [])
            else:
                assert {r.doc_id for r in got} == {r[0] for r in given}
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == bool(given)
