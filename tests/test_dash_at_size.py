"""DASH documents are parsed once, by many tasks; URLs with one token are filled by the short way."""

import pytest

from pagequarry.operators import manifests as m
from pagequarry.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["dash_timeline", "dash_segments"])
def test_documents_are_parsed_once_by_many_tasks(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan
    assert plan.rindex("Repartition ") > plan.rindex("posexplode")  # below it: rows are dealt out before documents are parsed


@pytest.mark.parametrize("media", ["$Number$.m4s", "a/$Number%05d$.m4s", "$Time$", "t_$Time%03d$/", "$Number%03d$_$Time$.m4s", "$Number%02d$-$Number%04d$", "$$-$Number$", "x.m4s", "$RepresentationID$_$Number%012d$?a=$Bandwidth$"])
def test_tokens_of_templates(spark, media):
    head = f'<MPD mediaPresentationDuration="PT21S"><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate initialization="i.mp4" media="{media}" startNumber="9" timescale="10" '
    tail = '</SegmentTemplate><Representation id="v" bandwidth="1"/></AdaptationSet></Period></MPD>'
    bodies = [head + 'duration="100">' + tail, head + '><SegmentTimeline><S d="5"/><S t="7" d="10" r="1"/><S/></SegmentTimeline>' + tail, head + "><SegmentTimeline></SegmentTimeline>" + tail]
    reps = m.dash_representations(spark.createDataFrame([(f"https://m.example.com/{i}/x.mpd", b) for i, b in enumerate(bodies)], "url string, body string"))
    slow = m.fill_template
    for rows, times, first in ((m.dash_segments(reps), [80, 90, 100], 9), (m.dash_timeline_segments(reps), [0, 7, 17], 1)):
        got = sorted((r.seg_no, r.is_init, r.seg_url) for r in rows.collect())
        at = "https://m.example.com/" + ("0" if first == 9 else "1")
        want = [(0, True, f"{at}/i.mp4")]
        for n, t in enumerate(times):
            filled = spark.range(1).select(slow(*map(m.F.lit, (media, "v", 1, first + n, t))).alias("x")).first().x
            want.append((n + 1, False, f"{at}/{filled}"))
        assert got == want
