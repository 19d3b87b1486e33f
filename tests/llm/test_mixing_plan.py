"""What a document gives to the mix is what the slots of the schedule take."""
import pytest

from tidemark.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta"
    return spark.createDataFrame([(i, f"s{i % 3}", " ".join([words] * (1 + i % 7))) for i in range(60)], "doc_id long, source string, text string")


@pytest.mark.parametrize("keep", ["slot % 2 = 0", "slot < 0"])
def test_missing_slots_are_not_taken(docs, monkeypatch, keep):
    whole = mixing.mix(docs, block=16)
    full = {r.doc_id: r.taken for r in whole.documents.collect()}
    plan = {(r["_s"], r["rank"]): r for r in whole.schedule.collect()}
    assert sum(full.values()) == sum(min(16, r["take"] - 16 * rank) for (_, rank), r in plan.items())
    real = mixing.slots
    monkeypatch.setattr(mixing, "slots", lambda sources, block: real(sources, block).where(keep))
    part = mixing.mix(docs, block=16)
    some = {r.doc_id: r for r in part.documents.collect()}
    left = sum(min(16, r["take"] - 16 * r["rank"]) for r in part.schedule.collect())
    assert len(some) == 60 and sum(r.taken for r in some.values()) == left < sum(full.values())
    assert all(r.taken <= full[i] and (r.taken > 0) == (r.first_slot is not None) for i, r in some.items())
