import hashlib

import numpy as np
import pytest

from barograph.llm import passage_dedup
from barograph.llm.common import gram_hashes, text_hashes
from barograph.llm.passage_dedup import dedup_passages
from tests.llm.test_passage_dedup import brute


@pytest.mark.parametrize("hot, most", [(4096, 4 * 120), (16, 15 * 120)])
def test_a_phrase_of_many_passages_sends_no_segment_to_all_shards(spark, monkeypatch, hot, most):
    # the phrase of least hash is the anchor of all windows that hold it
    phrase = min((" ".join(f"p{i}x{j}" for j in range(8)) for i in range(5000)), key=lambda t: int(gram_hashes(text_hashes(t), 8)[0]))
    passages = [" ".join([*(f"a{i}x{j}" for j in range(15)), phrase, *(f"b{i}x{j}" for j in range(15))]) for i in range(60)]
    rows = [(k * 1000 + i, f"{'l' * (k + 1)}{i} {t} r{k}") for k in range(2) for i, t in enumerate(passages)]
    sent, whole = [], passage_dedup.located
    monkeypatch.setattr(passage_dedup, "HOT", hot, raising=False)
    monkeypatch.setattr(passage_dedup, "located", lambda parts, *a: sent.append(parts.count()) or whole(parts, *a))
    got = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), shard_chars=500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got} == brute(rows, 20)
    assert sum(r.n_removed for r in got) == 60 * 38 and 60 <= sent[0] <= most


def test_few_anchors_that_do_not_recur_pass_the_filter(spark):
    rng = np.random.default_rng(5)
    held, others = (rng.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(2))
    bits = 1 << (2 * len(held)).bit_length()  # 8 to 16 for each hash in all
    passed = passage_dedup.anchor_filter(spark.createDataFrame([(int(x),) for x in held], "hash long"), bits)
    assert passage_dedup.may_recur(passed, bits, held.view(np.uint64)).all()
    assert passage_dedup.may_recur(passed, bits, others.view(np.uint64)).mean() < 0.01
