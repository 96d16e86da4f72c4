import random
import time

from pyspark.sql import functions as F

from docaudit.operators import tables as tb

HEAD = "| QUANTITY | DESCRIPTION | UNIT PRICE | TOTAL |\n|---|---|---|---|\n"
CASES = {
    1: (HEAD + "| 2 | red anvil | 10.00 | 20.00 |\n| 3 | big gear | 5.00 | 15.00 |\n| | | SUBTOTAL | 35.00 |\n",
        [(None, "red anvil", 2, 10, 20), (None, "big gear", 3, 5, 15)]),
    2: (HEAD + "| 2 | red anvil | 10.00 | 20.00 |\npage 2\n| 3 | big gear | 5.00 | 15.00 |\n| 4 | small rod | 2.00 | 8.00 |\n",
        [(None, "red anvil", 2, 10, 20), (None, "big gear", 3, 5, 15), (None, "small rod", 4, 2, 8)]),
    3: ("| TOTAL | QUANTITY | DESCRIPTION | UNIT PRICE |\n|---|---|---|---|\n| 5 pcs. | red anvil | € 200 | € 1000 |\n| 2 pcs. | big gear | € 30 | € 60 |\n",
        [(None, "red anvil", 5, 200, 1000), (None, "big gear", 2, 30, 60)]),
    4: ("| Item # | Description | Price | Total |\n|--|--|--|--|\n| 25 | 3-200 - Doors (2) | 10.00 | 20.00 |\n| 26 | 3-230 - Anchor Bolts (21) 41.41 | | 869.61 |\n",
        [(25, "3-200 - Doors (2)", 2, 10, 20), (26, "3-230 - Anchor Bolts (21)", 21, 41.41, 869.61)]),
    5: ("| Ordered Service | Item Price | Total |\n|--|--|--|\n| 1 1-013 - Project Coordinator (26) | 2.00 | 52.00 |\n"
        "| 2 2-782 - Brick Pavers (7) 41.69 | | 291.83 |\n| 3 x (25) | 99.25 | 2481.25 |",
        [(1, "1-013 - Project Coordinator (26)", 26, 2, 52), (2, "2-782 - Brick Pavers (7)", 7, 41.69, 291.83), (3, "x (25)", 25, 99.25, 2481.25)]),
    6: ("| Make/Model | Product Code | Unit Price |\n|--|--|--|\n| Cat skid | A-1 | $100 |\n| Cat loader | B-2 | $250 |\n",
        [(None, "Cat skid A-1", None, None, 100), (None, "Cat loader B-2", None, None, 250)]),
    7: ("| Item # | Ordered Service | Item Price | Total |\n|--|--|--|--|\n| 1 8-200 - Wood and Plastic | Doors (9) | 1.00 | 9.00 |\n| 2 8-300 - Steel | Beams (3) | 2.00 | 6.00 |\n",
        [(1, "8-200 - Wood and Plastic Doors (9)", 9, 1, 9), (2, "8-300 - Steel Beams (3)", 3, 2, 6)]),
    8: (HEAD + "| 2 | red anvil | 10.00 | 20.00 |\n| 2 | big anvil | 10.00 | 20.00 |\n\nx\n| | BPXPN-00052 | | |\n| 3 | big gear | 5.00 | 15.00 |\n",
        [(None, "red anvil", 2, 10, 20), (None, "big anvil", 2, 10, 20), (None, "big gear", 3, 5, 15)]),
    9: ("| Address | City |\n|--|--|\n| foo | bar |\n", []),
    # the description cell holds only a number, the name has slipped to the price cell
    10: ("| Description | Price | Total |\n|--|--|--|\n| 26 | 3-230 - Anchor Bolts (21) 41.41 | 869.61 |\n| 28 | Rods (2) 3.00 | 6.00 |\n",
         [(26, "3-230 - Anchor Bolts (21)", 21, 41.41, 869.61), (28, "Rods (2)", 2, 3, 6)]),
    # amount two cells on
    11: ("| Service | Price | Total | x |\n|--|--|--|--|\n| Wall (25) | 99.25 |  | 2481.25 |\n| Door (2) | 3.00 | 6.00 | |\n",
         [(None, "Wall (25)", 25, 99.25, 2481.25), (None, "Door (2)", 2, 3, 6)]),
}


def test_golden_tables(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "document_id long, markdown string")
    got = {k: [] for k in CASES}
    for r in tb.parse_line_items(docs).orderBy("document_id", "ord").collect():
        got[r.document_id].append((r.position, r.description, r.quantity, r.unit_price, r.amount))
    assert got == {k: v[1] for k, v in CASES.items()}


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "document_id long, markdown string")
    one = tb.parse_line_items(docs.repartition(1))
    assert one.exceptAll(tb.parse_line_items(docs.repartition(4))).count() == 0


def _brute_best(rows, header):
    """The winner among all candidates, each scored over all rows (P5-P7 as stated)."""
    def judge(own):
        scored = F.transform(
            tb.candidate_mappings(tb.column_shapes(rows)),
            lambda m: tb.let(tb.score_mapping(rows, m), lambda s: F.struct(m.alias("m"), s["n"].alias("n"), tb._share(s).alias("v"))))
        good = F.filter(scored, lambda x: (x["n"] >= 2) & (x["v"] > tb._share(own)))
        top = F.array_max(F.transform(good, lambda x: x["v"]))
        found = tb._first(good, lambda x: x["v"] == top)["m"]
        return F.when((own["n"] > 0) & (tb._share(own) >= 0.5), header).otherwise(F.coalesce(found, header))

    return tb.let(tb.score_mapping(rows, header), judge)


def _random_table(rng):
    """Columns in a random order, some of them products, with holes, marks, numbers and quantities in texts."""
    width, height = rng.randint(3, 6), rng.randint(2, 7)
    small = rng.random() < 0.5
    lines = []
    for _ in range(height):
        q, p = rng.randint(1, 5 if small else 30), rng.choice([1.0, 2.0, 2.5, 0.0, round(rng.uniform(0, 99), 2)])
        name = rng.choice(["red anvil", "Bolts ({q})", "Rope x {q}", "Rods qty {q}", "big gear ({q}) {p}", "7", "12.", "long description"]).format(q=q, p=p)
        cells = [name, f"{q}", f"{p}", f"{q * p:.2f}" if rng.random() < 0.85 else "3.00"]
        cells += [rng.choice(["1", "2.00", f"{q * p:.2f}", f"{p}", "", "x"]) for _ in range(width - 3)]
        cells = [("" if rng.random() < 0.12 else c) for c in cells]
        if rng.random() < 0.1:
            cells[2] = name + f" {p}"
        lines.append(cells)
    if rng.random() < 0.3:
        lines = [[c[0], c[1] + " pcs.", *c[2:]] for c in lines]
    if rng.random() < 0.3:
        lines = [[*c[:2], "$" + c[2], "$" + c[3], *c[4:]] for c in lines]
    order = rng.sample(range(len(lines[0])), len(lines[0]))
    return [[c[i] for i in order] for c in lines]


def test_best_mapping_equals_scoring_all_candidates(spark):
    rng = random.Random(12)
    tables = [_random_table(rng) for _ in range(400)]
    data = [(i, t, {"d": 0, "p": 1, "t": None, "a": 2, "q": None}) for i, t in enumerate(tables)]
    df = spark.createDataFrame(data, f"i int, t array<array<string>>, h {tb.MAPPING}").repartition(8)
    df = df.select("i", F.transform("t", tb._typed_row).alias("r"), "h")
    both = df.select("i", tb.best_mapping(F.col("h"), F.col("r")).alias("got"), _brute_best(F.col("r"), F.col("h")).alias("want")).collect()
    assert [(r.i, r.got, r.want) for r in both if r.got != r.want] == []
    assert len({r.got for r in both}) > 20


def test_wide_tables_take_seconds(spark):
    """30 columns and 500 rows under misleading names."""
    rng = random.Random(13)
    names = ["Total", "Price", "Description"] + [f"c{i}" for i in range(27)]
    lines = []
    for _ in range(500):
        q, p = rng.randint(1, 40), round(rng.uniform(1, 500), 2)
        cells = [f"{rng.uniform(1, 9999):.2f}" for _ in range(30)]
        cells[2], cells[11], cells[17], cells[25] = "long description of a thing", f"{p}", f"{q}", f"{q * p:.2f}"
        lines.append("| " + " | ".join(cells) + " |")
    md = "| " + " | ".join(names) + " |\n" + "|--" * 30 + "|\n" + "\n".join(lines)
    docs = spark.createDataFrame([(1, md)], "document_id long, markdown string")
    started = time.time()
    got = tb.parse_line_items(docs).collect()
    assert time.time() - started < 60
    first = lines[0].strip("| ").split(" | ")
    assert len(got) == 500 and (got[0].unit_price, got[0].quantity, got[0].amount) == (float(first[11]), float(first[17]), float(first[25]))


def test_units_of_word_columns_still_bar_quantities(spark):
    rows = [["red anvil", "2 pcs each", "3", "4", "12"], ["blue anvil", "5 pcs all", "5", "6", "30"], ["iron anvil", "1 pcs", "2", "8", "16"]]
    bare = [[r[0], "plain words", *r[2:]] for r in rows]
    marked = [[*r[:1], "plain words", f"{r[2]} pcs.", *(f"€ {x}" for x in r[3:])] for r in rows]
    df = spark.createDataFrame([(i, x) for i, x in enumerate((rows, bare, marked))], "i int, t array<array<string>>")
    typed = df.select("i", tb.typed_rows(F.col("t")).alias("t"))
    every = tb.candidate_mappings(tb.column_shapes(F.col("t")))
    scored = F.transform(every, lambda m: tb.score_mapping(F.col("t"), m))
    found = tb.best_candidate(F.col("t"), tb.column_shapes(F.col("t"), numeric=True), F.lit(0.0))
    for r in typed.select(every.alias("m"), scored.alias("s"), found.alias("best")).collect():
        share = [x.ok / x.n if x.n >= 2 else 0.0 for x in r.s]
        assert r.best == (r.m[share.index(max(share))] if max(share, default=0) > 0 else None)


def test_summary_rows_without_a_likely_word(spark):
    from docaudit.functions.cells import is_summary_row

    rows = [["Discount:", "5"], [" 할인 ", "1"], ["red anvil", "5"], ["red anvil", None], [None, "balance"], ["Sub  Total", "x"], ["discounted", "5"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<string>")
    got = [x.v for x in df.orderBy("i").select(is_summary_row(F.col("r")).alias("v")).collect()]
    assert got == [True, True, False, None, True, True, False]


def test_lines_move_by_part_once_and_stay_with_their_order(spark, tmp_path):
    from docaudit import fixtures

    spark.sql("select 1L as l_orderkey, id + 1 as l_linenumber, id % 2 as l_partkey, 1L as l_suppkey, timestamp '2024-01-01' as l_shipdate,"
              " 10.0D as l_extendedprice, 2.0D as l_quantity from range(4)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select * from values (0L, 'a'), (0L, 'b'), (2L, 'x'), (null, 'n') as t(p_partkey, p_name)").write.parquet(f"{tmp_path}/part.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        items = fixtures.inv_items_exact(spark, str(tmp_path))
        # a part that comes twice gives two rows of one place; one that is missing gives a row without a name
        assert sorted((r.position, r.description or "") for r in items.collect()) == [
            (1, "a"), (1, "b"), (2, ""), (3, "a"), (3, "b"), (4, "")]
        plan = fixtures.md_single(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
