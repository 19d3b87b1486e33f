"""Feature panel, labels and the diagnostics on them."""
from __future__ import annotations

from ..operators import features as ft
from ..session import cut_lineage, fingerprint
from ..sources.fixtures import SETTINGS
from . import feature_sql as fs
from .channel_core import stored as tables
from .prelude import cte
from .registry import query


def history(spark, sf):
    t = tables(spark, sf)
    return ft.partner_history(t.base, t.master, t.targets, SETTINGS)


_PANELS: dict = {}


def panel(spark, sf, cutoffs=None, label=True):
    """The panel over the given directory. It is written once per session to the checkpoint folder and shared by the
    queries of the same session, as a nightly job would share a stored table."""
    cutoffs = tuple(cutoffs or SETTINGS.train_cutoffs)
    key = (spark.sparkContext.applicationId, sf, fingerprint(spark, sf), cutoffs, label)
    if key not in _PANELS:
        _PANELS[key] = cut_lineage(ft.build_panel(history(spark, sf), list(cutoffs), SETTINGS, label=label))
    return _PANELS[key]


def score_snapshot(spark, sf):
    return panel(spark, sf, [SETTINGS.score_cutoff], label=False)


@query("feature_panel", "FLT-02 JN-10 JN-11 SE-01 WN-02 WN-03 WN-04 WN-05 WN-06 AG-19 AG-21 PRJ-05 2.16",
       cte("panel") + f"SELECT partner_id, cutoff, partner_type, tier, region, {', '.join(fs.ALL_NUM)}, "
       f"{', '.join(fs.LABEL_EXPR)} FROM panel WHERE cutoff < '2001-Q2'",
       dbl=" ".join(fs.ALL_NUM) + " baseline_4q_revenue next_q_revenue")
def feature_panel(spark, sf):
    return ft.build_panel(history(spark, sf), SETTINGS.train_cutoffs, SETTINGS)


@query("feature_snapshot", "2.16 FLT-02", cte("now") +
       f"SELECT partner_id, cutoff, partner_type, tier, region, {', '.join(fs.ALL_NUM)} FROM now", dbl=" ".join(fs.ALL_NUM))
def feature_snapshot(spark, sf):
    return ft.build_panel(history(spark, sf), [SETTINGS.score_cutoff], SETTINGS, label=False)


@query("churn_labels", "LB-01", cte("raw0") + "SELECT partner_id, cutoff, baseline_4q_revenue, next_q_revenue, left_zero, "
       "left_token, left_persistent FROM raw0 WHERE cutoff < '2001-Q2'", dbl="baseline_4q_revenue next_q_revenue")
def churn_labels(spark, sf):
    return ft.snapshots(history(spark, sf), SETTINGS.train_cutoffs, SETTINGS).select("partner_id", "cutoff", *ft.LABELS)
