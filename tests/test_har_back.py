"""The extended HAR is read again member by member."""

import netloom.plans as plans

DATA = "/root/testdata/sf0.001"


def test_entries_are_read_without_a_variant_each(spark, capsys):
    plans.QUERIES["har_entries_back"](spark, DATA).explain()
    out = capsys.readouterr().out.lower()
    assert "from_json" in out and "variant" not in out
