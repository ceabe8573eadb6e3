"""Lines put together from words, against a walk over each page's words."""

from __future__ import annotations

import random

from folio.operators.lines import LINE_GAP, assemble_lines


def test_lines_of_words_are_those_of_a_walk(spark):
    rng = random.Random(5)
    words = [("d", p, rng.choice([None, *(round(rng.uniform(0, 40), 1) for _ in range(5))]), float(rng.randrange(90)), rng.choice([9.0, 11.5, None]), rng.choice(["Times", "Arial-BOLD", None]), rng.choice(["a", "b", " c", " "])) for p in range(60) for _ in range(1 + p % 23)]
    got = assemble_lines(spark.createDataFrame(words, "document_id string, page int, top double, x0 double, size double, fontname string, text string"))
    assert "concat(a.nos" not in got._jdf.queryExecution().logical().toString()
    want = {}
    key = lambda x: (x is not None, x)
    for page in range(60):
        ws = [(t, x, w, t, s or 10.0, f or "") for _, p, t, x, s, f, w in words if p == page]
        lines, anchor = [[]], None
        for w in sorted(ws, key=lambda v: (key(v[0]), v[1], v[2], key(v[3]), v[4], v[5])):
            if anchor is None or abs(w[0] - anchor) <= LINE_GAP:
                anchor = w[0] if anchor is None else anchor
            else:
                lines, anchor = [*lines, []], w[0]
            lines[-1].append(w)
        for n, ln in enumerate(lines):
            want[page, n] = (" ".join(w[2] for w in ln).strip(), sum(w[4] for w in ln) / len(ln), any("bold" in w[5].lower() for w in ln), ln[0][3])
    rows = {(r.page, r.line_in_page): r for r in got.collect()}
    assert {*rows} == {*want}
    for k, (text, size, bold, y0) in want.items():
        assert (rows[k].text, rows[k].is_bold, rows[k].y0) == (text, bold, y0) and abs(rows[k].font_size - size) <= 0.051
