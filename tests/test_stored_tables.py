"""A prepared table is built when it is first read."""
import shutil

from tidemark.operators import facts
from tidemark.plans import insights
from tidemark.sources.fixtures import Channel


def test_lines_alone_build_no_grid(spark, sf, monkeypatch):
    built = []
    keep = facts.stored_table

    def noted(session, folder, name, build, partition_by=()):
        built.append(name)
        return keep(session, folder, name, build, partition_by)

    monkeypatch.setattr(facts, "stored_table", noted)
    t = facts.ChannelTables.stored(Channel(spark, sf))
    assert insights.margin_mix(t).count() == 36
    assert built == ["lines"]
    plain = facts.ChannelTables.of(Channel(spark, sf))
    assert t.partner_quarter.count() == plain.partner_quarter.count()
    assert built == ["lines", "partner_quarter", "partner_month"]


def test_one_pass_over_the_lines_does_not_write_them(spark, sf, tmp_path):
    from tidemark import catalog, session
    folder = shutil.copytree(sf, tmp_path / "own").as_posix()
    mix = lambda: sorted(map(tuple, catalog.load()["partner_product_mix"].fn(spark, folder).collect()))
    plain = mix()
    assert not session.is_stored(spark, folder, "lines")
    catalog.load()["margin_mix"].fn(spark, folder).count()
    assert session.is_stored(spark, folder, "lines")
    assert plain and mix() == plain
