"""Registered model queries run the whole operator: its own defaults, all columns and the real tags."""
import inspect
from types import SimpleNamespace

import pytest

from tidemark.catalog import desk
from tidemark.operators import intake
from tidemark.plans import experiments, triage


@pytest.fixture
def caught(monkeypatch):
    """Arguments of the plans' calls by name, with defaults filled in, instead of their results."""
    calls = {}

    def catch(module, name):
        sign = inspect.signature(getattr(module, name))

        def call(*args, **kwargs):
            bound = sign.bind(*args, **kwargs)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return (calls[name],)
        monkeypatch.setattr(module, name, call)

    for name in ("make_run", "interaction_check"):
        catch(experiments, name)
    return calls


def test_interactions_see_the_real_severity(spark, caught, monkeypatch):
    inbox = spark.createDataFrame([(1, "[Severity: HIGH] all is down."), (2, "nothing said")], "ticket_id long, body string")
    split = spark.createDataFrame([(1, 0, "P1", "train"), (2, 1, "P2", "train")], "ticket_id long, fold int, priority string, split string")
    monkeypatch.setattr(desk, "Desk", lambda *a: SimpleNamespace(inbox=inbox))
    monkeypatch.setattr(desk, "split_tickets", lambda *a: split)
    from tidemark.functions import text
    from pyspark.sql import functions as F
    want = {r.ticket_id: r.s if r.s in ("low", "medium", "high", "critical") else "none" for r in inbox.select("ticket_id", F.lower(text.severity(F.col("body"))).alias("s")).collect()}
    desk.factor_interactions(spark, "x")
    assert caught["interaction_check"]["folds"] == 5 and caught["interaction_check"]["max_iter"] == 30
    got = {r.ticket_id: r.severity_tag for r in caught["interaction_check"]["tagged"].select("ticket_id", "severity_tag").collect()}
    assert got == want and got[1] == "high"


def test_desk_models_have_their_defaults():
    source = inspect.getsource(desk)
    assert "folds=" not in source and "max_iter=" not in source and "iters=" not in source
    assert inspect.signature(intake.split_and_fold).parameters["folds"].default == 5 == inspect.signature(triage.Triage.train).parameters["folds"].default
