import os

import pytest

from kindred.errors import DuplicateKeyError
from kindred.queries import QUERIES
from kindred.streaming.index import StoredIndex

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture
def batches(monkeypatch):
    """Keys of each batch that is offered to an index, and whether it was refused."""
    seen, insert = [], StoredIndex.insert

    def noted(self, records, key, features):
        keys = {r[0] for r in records.select(key).collect()}
        try:
            out = insert(self, records, key, features)
        except DuplicateKeyError:
            seen.append((keys, True))
            raise
        seen.append((keys, False))
        return out

    monkeypatch.setattr(StoredIndex, "insert", noted)
    return seen


def test_a_refused_batch_holds_all_other_parts(spark, batches):
    every = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    live = {r.key for r in QUERIES["insert_reject_duplicates"](spark, SF).collect()}
    (first, _), (second, refused), (third, _) = batches
    assert refused and first | second == every and len(first & second) == 1
    assert live == first | third


def test_verified_index_holds_all_parts(spark, batches):
    every = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r.n for r in QUERIES["index_verify"](spark, SF).collect()} == {0}
    assert batches == [(every, False)]
