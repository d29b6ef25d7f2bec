import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelforge.llm.packing import WordTokens, pack_documents, plan
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(docs, capacity):
    got = pack_documents(docs, PATH, capacity).toPandas()
    ids = WordTokens(PATH).whole
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted(
        (-1 if d is None else d, at // capacity, at, len(x[at : at + capacity]), zlib.crc32(x[at : at + capacity].tobytes()))
        for d, t in texts for x in [np.asarray([*ids.encode(t, add_special_tokens=False).ids, 1], "<u4")] for at in range(0, len(x), capacity)
    )
    have = sorted(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None))
    assert have == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= capacity
    return got


def test_pieces_and_places(make):
    got = checked(make([prose(i, 5 + 37 * i) for i in range(30)]), 512)
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 512)


def test_odd_rows(odd, empty):
    checked(odd, 4096)
    assert pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_item_once_and_few_bins(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = min(100, 1 + int(rng.expovariate(1 / 25)))
        counts[n] = counts.get(n, 0) + 1
    rows, bins = plan(counts, 100)
    full, used = {}, {}
    for size, lo, hi, first, at in rows:
        assert lo == used.get(size, 0)
        used[size] = hi
        for b in range(first, first + hi - lo):
            full.setdefault(b, []).append((at, size))
    assert used == counts and set(full) == set(range(bins))
    for items in full.values():
        end = 0
        for at, size in sorted(items):
            assert at == end
            end += size
        assert end <= 100 and sum(3 * s > 100 for _, s in items) <= 2
    assert bins <= 1.02 * sum(k * n for k, n in counts.items()) / 100 + 1
