"""Tables of literal pages."""

from factloom.sources import html_tables as H

PAGE = """<table><caption>Results  of <b>2024</b></caption>
<thead><tr><th rowspan=2>KPI</th><th colspan=2>Cost</th><th rowspan="2">Note</th></tr><tr><th>Q1</th><th>Q2</th></tr></thead>
<tbody><tr><td>Invoices<td>$1,200.50<td>-3.5 %<td>none</tr><tr><td rowspan=0>Tickets<td colspan=2>40 hours<td>see 7<tr><td>5<td>&euro; 6<td></table>
<p>no table</p><table><tr><td>a<td><table><tr><td>x</td><td>1</td></tr><tr><td>y<td>2</table>out 3<tr><td>b<td colspan=9999>4<script>5</script>"""


def found(spark, *pages):
    return H.tables(spark.createDataFrame([(i, p, "clash") for i, p in enumerate(pages)], "id int, html string, rows string"))


def test_grids(spark):
    got = {r.table_index: r for r in found(spark, PAGE).collect()}
    first = got[0]
    assert (first.caption, first.row_count, first.headers) == ("Results of 2024", 5, 2)
    assert first.rows == [
        ["KPI", "Cost", "Cost", "Note"], ["KPI", "Q1", "Q2", "Note"], ["Invoices", "$1,200.50", "-3.5 %", "none"],
        ["Tickets", "40 hours", "40 hours", "see 7"], ["Tickets", "5", "€ 6", ""],
    ]
    assert (got[1].rows[0], got[2].rows) == (["a", "out 3"], [["x", "1"], ["y", "2"]])
    assert got[1].rows[1][:2] == ["b", "4"] and len(got[1].rows[1]) == 1 + H.COLSPAN and got[1].headers == 0


def test_metrics(spark):
    rows = H.metrics(found(spark, PAGE).where("table_index = 0"), "id").collect()
    got = {(r.row, r.column): (r.name, r.period, r.value, r.unit) for r in rows}
    assert got == {
        (2, 1): ("Invoices", "Cost Q1", 1200.5, "$"), (2, 2): ("Invoices", "Cost Q2", -3.5, "%"), (3, 1): ("Tickets", "Cost Q1", 40.0, "hours"), (3, 2): ("Tickets", "Cost Q2", 40.0, "hours"),
        (3, 3): ("Tickets", "Note", 7.0, ""), (4, 1): ("Tickets", "Cost Q1", 5.0, ""), (4, 2): ("Tickets", "Cost Q2", 6.0, "€"),
    }


def test_pages_without_tables(spark):
    assert found(spark, None, "", "<p>text</p>", "<tr><td>1</td></tr>").count() == 0
    empty = found(spark, "<table></table>", "<table><tr></tr></table>")
    assert [(r.row_count, r.rows) for r in empty.orderBy("id").collect()] == [(0, []), (1, [[]])]
    assert H.metrics(empty, "id").count() == 0
    assert H.tables(spark.createDataFrame([], "id int, html string")).count() == 0


def test_plain_pages_are_cut_as_the_parser_does():
    """Pages of plain pieces skip the parser; it gives the same for them, and still reads all others."""
    import random

    from factloom.sources import html_tables as H

    rng, skipped = random.Random(5), 0
    plain = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<caption>", "</caption>", '<td colspan="2">', '<th rowspan="2" colspan="3">', '<td rowspan="0">', '<p class="x">', "</p>", "<b>", "</b>", "a", " 5% ", "\n", "é", ">", '"', '<td colspan="2" colspan="1">', "<thead>", "</thead >", "<th\n>"]
    odd = ["&amp;", "&", "<br/>", "<TD>", "<td colspan=2>", "<script>", "</script>", "<!-- x -->", "<", "</td x=\"1\">", "<title>", "<textarea>", "<tdx>", "\x00", "<td title='a>b'>", "<td a=\"b\"c=\"d\">"]
    for n in range(3000):
        html = "".join(rng.choice(plain) if n % 2 or rng.random() < 0.9 else rng.choice(odd) for _ in range(rng.randint(0, 40)))
        slow, fast = H._Tables(), H._Tables()
        slow.feed(html)
        slow.close()
        fed = []
        fast.feed = lambda text, fed=fed, fast=fast: (fed.append(text), H.HTMLParser.feed(fast, text))
        fast.read(html)
        skipped += not fed
        assert [(t["caption"], t["rows"]) for t in fast.tables] == [(t["caption"], t["rows"]) for t in slow.tables], html
    assert skipped > 300
