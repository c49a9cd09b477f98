"""Standard notices are told apart, alone, edited and side by side."""

from stocktake.llm import license_scan


def test_every_notice_is_named_rightly(spark):
    rows, want = [], []
    for k, (name, notice) in enumerate(license_scan.NOTICES):
        words = notice.split()
        edited = " ".join(w for i, w in enumerate(words) if len(words) < 40 or i != 6)
        rows += [(2 * k, f"Some words before.\n{notice}\nand after it."), (2 * k + 1, "x " * k + edited.upper())]
        want += [(2 * k, name), (2 * k + 1, name)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), best=True).collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted(want)


def test_two_notices_in_one_text_are_both_named(spark):
    a, b = (dict(license_scan.NOTICES)[n] for n in ("GPL-2.0-or-later", "CC-BY-SA-4.0"))
    got = license_scan.scan(spark.createDataFrame([(1, a + "\n\n" + b), (2, None)], "doc_id long, text string"), best=True).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "CC-BY-SA-4.0"), (1, "GPL-2.0-or-later")]


def test_places_are_named_once():
    matches = [(0, 0, 0.9, 0, 30), (0, 1, 1.0, 2, 31), (0, 2, 1.0, 0, 9), (0, 3, 0.85, 60, 90), (1, 0, 0.8, 0, 30)]
    kept = license_scan.best_of(matches, [27, 26, 6, 27])
    assert sorted(kept) == [(0, 1, 1.0, 2, 31), (0, 3, 0.85, 60, 90), (1, 0, 0.8, 0, 30)]
