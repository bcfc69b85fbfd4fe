import pytest

import __spark_entry__ as entry
from wordloom.functions import config


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_overrides_keep_types():
    own = {"tighten": {"max_gap": 400, "use_vad": True, "margin": 12.5}, "fillers": {"words": ["um"]}, "script": {"file": None, "prefer": "best"}}
    assert config.override(own, "tighten.max_gap=150")["tighten"]["max_gap"] == 150 and own["tighten"]["max_gap"] == 400
    assert config.override(own, "tighten.use_vad=false")["tighten"]["use_vad"] is False
    assert config.override(own, "tighten.margin=3")["tighten"]["margin"] == 3.0
    assert config.override(own, 'fillers.words=["er"]')["fillers"]["words"] == ["er"]
    assert config.override(own, "script.prefer=null")["script"]["prefer"] is None
    for bad in ("tighten.max_gap=x", "tighten.max_gap=null", "tighten.other=1", "tighten=1", "tighten.use_vad=1", "fillers.words=er", "tighten.max_gap"):
        with pytest.raises(ValueError):
            config.override(own, bad)


def test_digest_reads_its_sections_only():
    a, b = {"x": {"k": 1, "l": "é"}, "y": {"k": 2}}, {"y": {"k": 3}, "x": {"l": "é", "k": 1}}
    assert config.digest(a, ["x"]) == config.digest(b, ["x"]) != config.digest(a, ["x", "y"])
    assert (config.profile(1080, 1920), config.profile(1080, 1920, 90), config.profile(1920, 1080)) == ("short", "long", "long")
