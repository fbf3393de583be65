"""Row access rules and audit rows."""

import pytest

from tracelake.errors import EngineError
from tracelake.plans import access


def test_leaf(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, team string")
    policy = access.Policy(rules=(("t", "team = 'a' or id = 3"), ("t", "id < 9")), closed=("hidden",))
    assert [r.id for r in policy.leaf("t", df).orderBy("id").collect()] == [1, 3]
    null = access.Policy(rules=(("t", "team = 'a'"),))
    assert [r.id for r in null.leaf("t", df).collect()] == [1]
    assert policy.leaf("other", df).count() == 3
    assert policy.leaf("t", df.where("false")).count() == 0
    with pytest.raises(EngineError) as e:
        policy.leaf("hidden", df)
    assert e.value.code == "permission_denied"


def test_hash():
    a, b = access.Policy(rules=(("t", "x"), ("u", "y"))), access.Policy(rules=(("u", "y"), ("t", "x")))
    assert a.hash() == b.hash() != access.Policy().hash()


def test_audit(spark):
    policy = access.Policy()
    row = access.audited(spark, "me", "q", policy, None, 3, "returned", 7).first()
    assert (row.actor, row.query_hash, row.policy_hash, row.as_of, row.generation, row.outcome, row.at_ms) == ("me", "q", policy.hash(), None, 3, "returned", 7)
    with pytest.raises(EngineError):
        access.audited(spark, "me", "q", policy, None, 3, "maybe", 7)
