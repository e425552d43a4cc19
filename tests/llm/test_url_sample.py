from cohortlens.llm import urls as U


def test_a_bounded_sample_has_both_classes_and_all_of_the_alphabet(spark, monkeypatch):
    """Blocked hosts come last in the alphabet, and one url is there many times."""
    rows = [(f"https://{'abcdefgh'[k % 8]}{k}.example/page", 0) for k in range(400)] + [(f"https://z{k}.example/casino", 1) for k in range(60)]
    rows += [("https://a.example/copy", 0)] * 300
    taken = []
    monkeypatch.setattr(U, "train", lambda got: taken.append(got))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    U.fit(spark, labelled, max_rows=100)
    U.fit(spark, labelled, max_rows=200)
    U.fit(spark, labelled, max_rows=1000)
    assert [len(x) for x in taken] == [100, 200, 760]
    assert [sum(b for *_, b in x) for x in taken] == [50, 60, 60]
    assert {h[0] for h, *_ in taken[0]} >= set("abcdefgh") and len(set(taken[0])) == 100
