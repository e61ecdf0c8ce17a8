import time
from datetime import timedelta

import pytest

from nuntia.sources import bop
from nuntia.streaming import stateful

RAW = "doc_id string, page_number int, raw_text string, n_pages int"
PAGES = {
    1: "portada", 2: "III. ADMINISTRACIÓN LOCAL\nAYUNTAMIENTO DE TELDE\nuno", 3: "dos", 4: "", 5: "CABILDO INSULAR DE LA PALMA\ntres", 6: "IV. ANUNCIOS\nAYUNTAMIENTO DE INGENIO\ncuatro", 7: "cinco", 8: "III. ADMINISTRACIÓN LOCAL\nseis",
}


@pytest.fixture
def stream(spark, tmp_path):
    """land(rows) adds rows to what a stream reads, run() processes them and returns rows out and rows of state."""
    stateful.use_state_store(spark)

    made = []

    class Stream:
        def __init__(self, schema, operator):
            made.append(self)
            self.schema, self.operator, self.path = schema, operator, tmp_path / str(len(made))

        def land(self, *rows):
            spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))

        def run(self):
            got = []
            source = spark.readStream.schema(self.schema).parquet(str(self.path / "in"))
            query = stateful.run_once(self.operator(source), lambda df, i: got.extend(df.collect()), str(self.path / "check"))
            assert query.awaitTermination(120)
            return got, query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None

    yield Stream
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def page(doc, n, total=8):
    return (doc, n, PAGES[n], total)


def test_pages_in_several_batches_have_the_headings_of_the_batch_plan(spark, stream):
    s = stream(RAW, lambda raw: stateful.bulletin_pages(raw, timedelta(hours=1), "n_pages"))
    batches = [[page("a", 1), page("a", 2), page("b", 5)], [page("a", 3), page("b", 1), page("a", 6)], [page("b", 4), page("b", 3), page("b", 2)], [page("a", 5), page("a", 4), page("a", 4), page("b", 6), page("b", 7)], [page("b", 8), page("a", 8), page("a", 7)]]
    got, sizes = [], []
    for batch in batches:
        s.land(*batch)
        rows, size = s.run()
        got += rows
        sizes.append(size)
    raw = spark.createDataFrame([page(d, n) for d in "ab" for n in PAGES], RAW)
    assert sorted(map(tuple, got)) == sorted(map(tuple, bop.pages(raw).collect())) and len(got) == 8
    assert {(r["page_number"], r["detected_organism"]) for r in got if r["doc_id"] == "a"} == {(2, "AYUNTAMIENTO DE TELDE"), (3, "AYUNTAMIENTO DE TELDE"), (5, "CABILDO INSULAR DE LA PALMA"), (8, "CABILDO INSULAR DE LA PALMA")}
    assert sizes[-1] == 0 and max(sizes) > 0  # both bulletins are complete, and their state is freed


def test_what_waits_goes_on_without_what_never_comes(stream):
    """Two pages wait for the first, which never comes, until the timer runs out; then the state is freed."""
    s = stream(RAW, lambda raw: stateful.bulletin_pages(raw, timedelta(milliseconds=500)))
    s.land(page("a", 2), page("a", 3), ("c", None, "no number", None))
    rows, _ = s.run()
    time.sleep(0.7)
    s.land(page("b", 1, 1))
    more, _ = s.run()
    rows = sorted(rows + more, key=lambda r: r["ordinal"])
    assert [(r["page_number"], r["detected_organism"]) for r in rows] == [(2, "AYUNTAMIENTO DE TELDE"), (3, "AYUNTAMIENTO DE TELDE")]


def test_values_are_carried_over_batches(stream):
    schema = "k string, n long, v int, w string"
    s = stream(schema, lambda rows: stateful.carried(rows, ["k"], "n", {"last_v": "int", "last_w": "string"}, stateful.last_known(["v", "w"]), timedelta(hours=1), first=0))
    s.land(("a", 0, None, "x"), ("a", 1, 5, None), (None, 0, 1, None))
    first = s.run()[0]
    s.land(("a", 2, None, None), ("a", 3, None, "y"), (None, 1, None, "z"), ("a", 1, 99, "again"))
    assert {tuple(r) for r in first} == {("a", 0, None, "x", None, "x"), ("a", 1, 5, None, 5, "x"), (None, 0, 1, None, 1, None)}
    assert {tuple(r) for r in s.run()[0]} == {("a", 2, None, None, 5, "x"), ("a", 3, None, "y", 5, "y"), (None, 1, None, "z", 1, "z")}


def test_what_was_reported_is_not_reported_again_for_a_while(stream):
    def reports(ttl):
        s = stream("url string, n int", lambda rows: stateful.first_seen(rows, ["url"], ["n"], ttl))
        s.land(("u", 2), ("u", 1), ("v", 5))
        first = sorted(map(tuple, s.run()[0]))
        s.land(("u", 0), ("w", None), ("w", 3))
        return first, sorted(map(tuple, s.run()[0]))

    assert reports(timedelta(hours=1)) == ([("u", 1), ("v", 5)], [("w", None)])
    assert reports(timedelta(milliseconds=1)) == ([("u", 1), ("v", 5)], [("u", 0), ("w", None)])


def test_numbers_go_on_until_state_is_given_up(stream):
    def numbers(patience):
        s = stream("k string, n int", lambda rows: stateful.numbered(rows, ["k"], ["n"], patience))
        out = []
        for rows in ([("a", 5), ("a", 3), ("b", 1)], [("c", 1)], [("a", 9)]):
            s.land(*rows)
            out.append({tuple(r) for r in s.run()[0]})
        return out

    first = [{("a", 3, 1), ("a", 5, 2), ("b", 1, 1)}, {("c", 1, 1)}]
    assert numbers(timedelta(hours=1)) == [*first, {("a", 9, 3)}]
    assert numbers(timedelta(milliseconds=1)) == [*first, {("a", 9, 1)}]
