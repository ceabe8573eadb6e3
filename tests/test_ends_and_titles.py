"""White space at the ends of texts and titles above nodes: cheap ways against plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.text import SPACES, cross_references, stripped
from folio.operators.tree import ancestors, build_nodes, with_breadcrumbs


def test_every_character_is_stripped_as_the_pattern_says(spark):
    rows = [(c, f"{chr(c)} x{chr(c)}y {chr(c)}") for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + [(0, ""), (-1, None), (-2, "  \n"), (-3, "a \r\n")]
    df = spark.createDataFrame(rows, "c int, t string")
    plain = F.regexp_replace("t", f"^{SPACES}|{SPACES.removeprefix('(?U)')}$", "")
    assert df.filter(~stripped(F.col("t")).eqNullSafe(plain)).count() == 0
    # no pattern looks at every place of every text
    assert "regexp" not in df.select(stripped(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    got = spark.createDataFrame([("Sections 2, 3 and 1.",), ("none",), (None,), ("section 9 of subsection 9",)], "t string").select(cross_references(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [["1", "2", "3"], [], [], ["9"]]


def test_titles_above_a_node_need_no_join(spark):
    depths = [1, 2, 3, 3, 1, 3, 2, 5, 4, 1, 2]
    blocks = [("d", n + 1, "heading", f"t{n}", n, 0.0, d, f"{n}", f"T{n}", None, None) for n, d in enumerate(depths)]
    df = spark.createDataFrame(blocks, "document_id string, block_no long, block_type string, text string, page int, y0 double, depth int, section_number string, title string, referenced_sections array<string>, table_id string")
    nodes = build_nodes(df, spark.createDataFrame([("d", "name")], "document_id string, document_name string"))
    want = {"root": ("", None, [])}
    for n, d in enumerate(depths):
        above, at = [], d
        for m in range(n - 1, -1, -1):
            if depths[m] < at:
                above, at = [m, *above], depths[m]
        want[f"d-node-{n + 1}"] = (" > ".join(f"T{m}" for m in [*above, n]), f"T{above[-1]}" if above else None, [*(f"d-node-{m + 1}" for m in reversed(above)), "root"])
    named = with_breadcrumbs(nodes)
    crumbs = {r.node_id: (r.breadcrumb, r.parent_section) for r in named.collect()}
    over = {r.node_id: r.ancestor_ids for r in ancestors(nodes).collect()}
    assert {k: (*crumbs[k], over[k]) for k in over} == want
    assert "Join" not in named._jdf.queryExecution().optimizedPlan().toString()
