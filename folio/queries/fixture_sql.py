"""SQL counterparts of the fixture queries."""

from __future__ import annotations

from folio.functions.text import STOP_EXTRACT, STOP_GROUND, STOP_QUERY
from folio.operators.generate import NOTHING_FOUND
from folio.operators.query import INTENTS
from folio.queries.corpus import BLOCKS_SQL, FONT_SQL, TOKENS
from folio.queries.fixture_queries import values
from folio.sources import fixtures as fx

REFERENCE = r"[Ss]ections?\s+(\d+(?:\.\d+){0,3}(?:\([a-z]\))?(?:\s*,\s*\d+(?:\.\d+){0,3})*(?:\s*,?\s*(?:and|&)\s*\d+(?:\.\d+){0,3})?)"


def refs(text: str) -> str:
    return f"list_sort(list_distinct(flatten(list_transform(regexp_extract_all({text}, '{REFERENCE}', 1), lambda m: regexp_extract_all(m, '\\d+(?:\\.\\d+){{0,3}}')))))"


def words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''))"


PAGES = values("pages_in", "line_no, page, y0, font_size, is_bold, text", [(k, *row) for k, row in enumerate(fx.CONTRACT, 1)])
STRIPPED = rf"""{PAGES},
keyed as (select *, regexp_replace(trim(text), '\d+', '#', 'g') as key from pages_in),
running as (select key from keyed group by key having count(distinct page) >= greatest(3, floor((select max(page) from pages_in) * 0.4)) and max(y0) - min(y0) <= 15 and (select max(page) from pages_in) >= 3),
lines as (select '{fx.DOC}' as document_id, * exclude (key) from keyed where key not in (select key from running))"""
TABLES = values("tables_in", "table_no, page, y0, headers, body", [(k, p, y, h, r) for k, (p, y, h, r) in enumerate(fx.CONTRACT_TABLES, 1)])
#: Text columns of the structure step lack page and height; they are taken from the lines in the same order.
PLACED = f"""{STRIPPED}, {FONT_SQL}, {BLOCKS_SQL}, {TABLES},
located as (select row_number() over (order by line_no) as block_no, page, y0 from lines where trim(text) <> ''),
flow as (select b.block_no as spot, 1 as kind, b.block_type, b.text, l.page, l.y0, 0 as table_no, b.depth, b.section_number, b.title from blocks b join located l using (block_no)
  union all select coalesce((select min(block_no) from located l where (l.page, l.y0) > (t.page, t.y0)), 1000000), 0, 'table_anchor', '[table:{fx.DOC}-tbl-' || table_no || ']', page, y0, table_no, 0, null, null from tables_in t),
ordered as (select *, row_number() over (order by spot, kind, page, y0, table_no) as no from flow)"""
TREE = f"""{PLACED},
n as (select *, coalesce(sum((block_type = 'heading')::int) over (order by no), 0) as node_no from ordered),
heads as (select node_no, coalesce(title, text) as title, depth, section_number, page from n where block_type = 'heading'),
links as (select h.*, (select max(g.node_no) from heads g where g.node_no < h.node_no and g.depth < h.depth) as up from heads h),
nodes0 as (select node_no, '{fx.DOC}-node-' || node_no as node_id, title, section_number, depth, coalesce('{fx.DOC}-node-' || up, 'root') as parent_id, page as s from links
  union all select 0, 'root', '{fx.NAME}', null, 0, null, null),
bodies as (select node_no, trim(string_agg(text, chr(10) order by no)) as raw, max(page) as e,
  list_distinct(flatten(list({refs("text")} order by no))) as node_refs from n where block_type = 'paragraph' group by node_no),
held as (select node_no, string_agg('{fx.DOC}-tbl-' || table_no, ',' order by no) as tables from n where block_type = 'table_anchor' group by node_no),
up as (with recursive c(node_id, ancestor, d) as (select node_id, node_id, 0 from nodes0 union all select c.node_id, x.parent_id, d + 1 from c join nodes0 x on x.node_id = c.ancestor where x.parent_id is not null) select * from c),
own as (select node_id, s, case when s is null and e is null then null else greatest(coalesce(s, 0), coalesce(e, 0)) end as e from nodes0 left join bodies using (node_no)),
span as (select u.ancestor as node_id, min(o.s) as page_start, max(o.e) as page_end from up u join own o using (node_id) group by 1),
kids as (select parent_id as node_id, string_agg(title, ', ' order by node_no) as titles from nodes0 where parent_id is not null group by 1),
nodes as (select x.*, p.page_start, p.page_end, coalesce(b.raw, '') as raw, b.node_refs, h.tables,
  case when x.node_id = 'root' then case when k.titles is null then x.title else x.title || '. Covers: ' || k.titles || '.' end
    when k.titles is not null then substr(x.title || '. Includes: ' || k.titles || '.', 1, 240) when length(coalesce(b.raw, '')) > 240 then substr(b.raw, 1, 240) || '…' else coalesce(b.raw, '') end as summary
  from nodes0 x left join bodies b using (node_no) left join held h using (node_no) left join span p using (node_id) left join kids k using (node_id))"""
ORDERED_REFS = "list_filter(node_refs, lambda r, i: true)"
CRUMBS = f"""crumbs as (select u.node_id, string_agg(a.title, ' > ' order by u.d desc) as breadcrumb, max(a.title) filter (u.d = 1) as parent_section from up u join nodes0 a on a.node_id = u.ancestor where u.ancestor <> 'root' group by 1)"""

TOPICS = ", ".join(f"case when contains(low, '{stem}') then {list(t)!r} else [] end" for stem, t in INTENTS)
SEARCH = rf"""{TREE}, {values("asked", "query_id, q", [(q[0], q[2]) for q in fx.CONTRACT_QUESTIONS])},
an as (select query_id, list_filter(regexp_extract_all(lower(q), '[a-zA-Z'']+'), lambda w: length(w) > 2 and not list_contains({list(STOP_QUERY)!r}, w)) as kw,
  list_distinct(regexp_extract_all(lower(q), 'section\s+(\d+(?:\.\d+){{0,3}})', 1)) as refs, list_distinct(flatten([{TOPICS.replace("low", "lower(q)")}])) as topics from asked),
sc as (select query_id, node_id, node_no, case when list_contains(refs, section_number) then 10 else 0 end + 3 * len(list_filter(topics, lambda x: contains(lower(title || ' ' || summary), x)))
  + len(list_filter(kw, lambda x: contains(lower(title || ' ' || summary), x))) as score from nodes, an where node_id <> 'root')"""

HITS = values("hits_in", "query_id, document_id, source, chunk_id, score, rank", fx.FUSION_HITS)
POOL = f"""{HITS}, {values("chunks_in", "document_id, chunk_id, chunk_no, node_id, section_number, refs, table_id", fx.FUSION_CHUNKS)},
{values("nodes_in", "document_id, node_id, node_no, section_number", fx.FUSION_NODES)}, {values("asked", "query_id, explicit", fx.FUSION_QUERIES)},
scaled as (select *, case source when 'vector' then 0 when 'lexical' then 1 else 2 end as o,
  case when min(score) over p = max(score) over p then 1.0 else (score - min(score) over p) / (max(score) over p - min(score) over p) end as s from hits_in window p as (partition by query_id, source)),
pool as (select query_id, chunk_id, avg(s) * (1 + 0.15 * (count(*) - 1)) as fused, string_agg(source, ',' order by o) as prov, min(o * 1000 + rank) as pool_no from scaled group by all)"""
BOOSTED = f"""{POOL},
boosted as (select p.query_id, p.chunk_id, fused + case when list_contains(a.explicit, c.section_number) then 5 else 0 end as fused,
  prov || case when list_contains(a.explicit, c.section_number) then ',explicit_reference' else '' end as prov, pool_no from pool p join chunks_in c using (chunk_id) join asked a using (query_id))"""


def fused(table: str) -> str:
    return f"select query_id, chunk_id, round(fused, 6) as fused_score, prov as provenance, row_number() over (partition by query_id order by round(fused, 9) desc, pool_no) as rank from {table}"


CONTEXT = f"""{values("rows_in", "query_id, document_id, no, chunk_id, node_id, section, title, parent, p1, p2, score, text", fx.CONTEXT_ROWS)},
marked as (select *, row_number() over (partition by query_id, node_id, substr(text, 1, 60) order by no) as again from rows_in),
grouped as (select query_id, node_id, min_by(section, no) as section, min_by(title, no) as title, min_by(coalesce(parent, ''), no) as parent, min(p1) as s, max(p2) as e, min_by(p1, no) as fp, min_by(p2, no) as fe,
  string_agg(trim(text), chr(10) || chr(10) order by no) filter (again = 1) as text, string_agg(chunk_id, ',' order by no) as chunk_ids, max(score) as best, min(no) as seen from marked group by all),
placed as (select *, row_number() over (partition by query_id order by fp, coalesce(string_split(section, '.')[1]::int, 9999), seen) as order_no,
  '[Source: Doc' || coalesce(', Section ' || section, '') || ', ' || case when fp = fe then 'Page ' || fp else 'Pages ' || fp || '-' || fe end || ']' as citation,
  '[Document: Doc' || case when section is not null then ' | Section ' || section || coalesce(' (' || title || ')', '') when title is not null then ' | ' || title else '' end
    || case when parent <> '' then ' | Parent: ' || parent else '' end || ' | ' || case when s = e then 'Page ' || s else 'Pages ' || s || '-' || e end || ']' || chr(10) || text as rendered from grouped)"""
BUDGET = f"""{CONTEXT},
summed as (select *, row_number() over w as k, sum({words("rendered")}) over w + row_number() over w - 1 as total from placed window w as (partition by query_id order by best desc, order_no desc)),
kept as (select *, k = 1 or greatest(1, floor(total * 1.3::double)) <= 38 as fits from summed)"""

BLOCKS = values("blocks_in", "no, name, section, title, text, citation", [(k, *b) for k, b in enumerate(fx.ANSWER_BLOCKS, 1)])
CONTEXT_TEXT = "\n".join(b[3] for b in fx.ANSWER_BLOCKS)


def bag(text: str, stop: tuple[str, ...]) -> str:
    return f"list_filter(list_distinct({TOKENS.format(text)}), lambda x: not list_contains({list(stop)!r}, x))"


CITED = r"\[Source:\s*([^,\]]+?)(?:,\s*Section\s+([\d.]+))?(?:,\s*Pages?\s+[\d\-]+)?\]"
PIECES = r"list_transform(string_split(regexp_replace({0}, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x))"
GROUND = rf"""{values("cases", '"case", answer', fx.ANSWER_CASES)}, {BLOCKS},
ctx as (select string_agg(text, chr(10) order by no) as t, list(citation) as own, list(section) filter (section is not null) as known from blocks_in),
c2 as (select *, upper(trim(answer)) like 'INSUFFICIENT EVIDENCE%' as refused, regexp_extract_all(answer, '{CITED}', 0) as full_c, regexp_extract_all(answer, '{CITED}', 2) as sec,
  list_filter({PIECES.format("answer")}, lambda s: length(s) > 15) as pieces, regexp_extract_all(answer, '\$?\d[\d,]*(?:\.\d+)?%?') as nums, {bag("ctx.t", STOP_GROUND)} as ct,
  list_transform(regexp_extract_all(ctx.t, '\$?\d[\d,]*(?:\.\d+)?%?'), lambda n: replace(n, ',', '')) as cn, ctx.own, ctx.known from cases, ctx),
c3 as (select *, list_filter(pieces, lambda s: len({bag(f"regexp_replace(s, '{CITED}', '', 'g')", STOP_GROUND)}) > 0 and
    len(list_intersect({bag(f"regexp_replace(s, '{CITED}', '', 'g')", STOP_GROUND)}, ct))::double / len({bag(f"regexp_replace(s, '{CITED}', '', 'g')", STOP_GROUND)}) < 0.25) as weak,
  list_filter(full_c, lambda f, i: not list_contains(own, f) and (coalesce(sec[i], '') = '' or not list_contains(known, sec[i]))) as bad,
  list_filter(nums, lambda n: length(replace(n, ',', '')) > 1 and not list_contains(cn, replace(n, ',', ''))) as strange from c2)"""
EXTRACT = rf"""{values("asked", "query_id, q", fx.EXTRACT_QUESTIONS)}, {BLOCKS},
s as (select query_id, no, name, section, unnest({PIECES.format("trim(text)")}) as s, generate_subscripts({PIECES.format("trim(text)")}, 1) as i, {bag("q", STOP_EXTRACT)} as qs from asked, blocks_in),
o as (select *, len(list_intersect(qs, {bag("s", STOP_EXTRACT)})) as n from s),
b as (select query_id, max(n) as n, arg_min({{'s': s, 'c': '[Source: ' || name || coalesce(', Section ' || section, '') || ']'}}, -n * 10000 + no * 100 + i) as x from o group by 1)"""

ORACLES: dict[str, str] = {
    "header_footer_strip": f"with {STRIPPED} select line_no, page, text from lines",
    "line_assembly": f"""with recursive {values("words_in", "page, top, x0, size, font, text", fx.WORD_BOXES)}, {values("boxes", "page, x0, top, x1, bottom", fx.TABLE_BOXES)},
      kept as (select w.*, round(w.top, 1) as t, row_number() over (partition by page order by round(w.top, 1), x0) as k from words_in w
        where not exists (select 1 from boxes b where b.page = w.page and b.x0 - 2 <= w.x0 and w.x0 + 5 <= b.x1 + 2 and b.top - 2 <= w.top and w.top <= b.bottom + 2)),
      walk(page, k, anchor, line) as (select page, k, t, 0 from kept where k = 1
        union all select n.page, n.k, case when abs(n.t - w.anchor) <= 2.5 then w.anchor else n.t end, case when abs(n.t - w.anchor) <= 2.5 then w.line else w.line + 1 end from walk w join kept n on n.page = w.page and n.k = w.k + 1)
      select page, line as line_in_page, string_agg(text, ' ' order by k) as text, round_even(avg(size), 1) as font_size, bool_or(contains(lower(font), 'bold')) as is_bold, min_by(top, k) as y0 from kept join walk using (page, k) group by page, line""",
    "heading_cases": f"""with {values("raw", "text, font_size, is_bold", fx.HEADING_CASES)}, lines as (select 'h' as document_id, row_number() over () as line_no, * from raw), body as (select 'h' as document_id, 10.0::double as body_font_size), {BLOCKS_SQL}
      select text, block_type = 'heading' as is_heading, section_number, title, case when block_type = 'heading' then depth end as depth from blocks""",
    "cross_reference_cases": f"with {values('raw', 'text', [(t,) for t in fx.REFERENCE_CASES])} select text, array_to_string({refs('text')}, ',') as refs from raw",
    # anchors stand among all lines here, running ones too
    "table_interleave": f"with {PLACED.replace('where key not in (select key from running)', '')} select no as block_no, block_type, text from ordered",
    "contract_tree": f"with {TREE} select node_id, node_no, title, section_number, depth, parent_id, page_start, page_end, summary, coalesce(array_to_string(list_sort(node_refs), ','), '') as refs, coalesce(tables, '') as tables from nodes",
    "tree_ancestors": f"with {TREE} select node_id, coalesce(string_agg(ancestor, ',' order by d) filter (d > 0), '') as ancestors from up group by 1",
    "tree_breadcrumbs": f"with {TREE}, {CRUMBS} select node_id, breadcrumb, parent_section from crumbs",
    "clause_split": rf"""with {values("raw", "node, text", fx.CLAUSE_CASES)},
      l as (select node, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) as k from raw),
      g as (select *, sum((k = 1 or regexp_matches(line, '^(\d+(?:\.\d+){{1,4}})\.?\s+'))::int) over (partition by node order by k) as c from l)
      select node, c - 1 as clause_no, string_agg(line, ' ' order by k) as clause from g group by node, c""",
    "table_markdown_cases": f"""with {TABLES} select '{fx.DOC}-tbl-' || table_no as table_id, case when len(headers) = 0 then array_to_string(list_transform(body, lambda r: array_to_string(r, ' | ')), chr(10))
      else '| ' || array_to_string(headers, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(headers, lambda h: '---'), ' | ') || ' |' || chr(10) || array_to_string(list_transform(body, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) end as markdown from tables_in""",
    # every section of the fixture fits one chunk
    "contract_chunks": f"""with {TREE}, {CRUMBS},
      t as (select node_id || '-chunk-1' as chunk_id, node_no as o, 'paragraph' as chunk_type, section_number, page_start, page_end, replace(raw, chr(10), ' ') as src, '[' || breadcrumb || ']' || chr(10) as head from nodes join crumbs using (node_id) where raw <> ''),
      tb as (select '{fx.DOC}-tbl-' || table_no || '-chunk' as chunk_id, 1000 + table_no as o, 'table' as chunk_type, (select section_number from nodes where contains(coalesce(tables, ''), '{fx.DOC}-tbl-' || table_no)) as section_number, page as page_start, page as page_end,
        case when len(headers) = 0 then array_to_string(list_transform(body, lambda r: array_to_string(r, ' | ')), chr(10)) else '| ' || array_to_string(headers, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(headers, lambda h: '---'), ' | ') || ' |' || chr(10) || array_to_string(list_transform(body, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) end as src, '' as head from tables_in),
      every as (select * from t union all select * from tb)
      select chunk_id, row_number() over (order by o) as chunk_no, chunk_type, section_number, page_start, page_end, greatest(1, floor({words("src")} * 1.3::double)::int) as token_count, head || src as display_text,
        case when chunk_type = 'table' then '' else array_to_string({refs("src")}, ',') end as refs from every""",
    "hierarchy_search": f"with {SEARCH} select query_id, node_id, score::double as score, rank from (select *, row_number() over (partition by query_id order by score desc, node_no) as rank from sc where score > 0) where rank <= 5",
    "hybrid_fusion": f"with {POOL} {fused('pool')}",
    "explicit_boost": f"with {BOOSTED} {fused('boosted')}",
    "crossref_expand": f"""with {BOOSTED},
      first_node as (select section_number, min_by(node_id, node_no) as node_id from nodes_in where section_number is not null group by 1),
      seeds as (select p.query_id, p.pool_no, unnest(c.refs[1:5]) as ref, generate_subscripts(c.refs[1:5], 1) as i from boosted p join chunks_in c using (chunk_id)),
      reached as (select s.query_id, t.chunk_id, min(s.pool_no * 1000000 + s.i * 1000 + t.chunk_no) as seen from seeds s join first_node f on f.section_number = s.ref join chunks_in t on t.node_id = f.node_id and t.table_id is null group by all),
      every as (select b.query_id, b.chunk_id, b.fused, b.prov || case when r.chunk_id is not null then ',cross_reference' else '' end as prov, b.pool_no from boosted b left join reached r using (query_id, chunk_id)
        union all select r.query_id, r.chunk_id, 0.3, 'cross_reference', 100000000000 + seen from reached r where not exists (select 1 from boosted b where b.query_id = r.query_id and b.chunk_id = r.chunk_id)) {fused('every')}""",
    "context_block_cases": f"with {CONTEXT} select query_id, node_id, order_no, citation, rendered, chunk_ids, best as max_rerank_score from placed",
    "context_budget": f"""with {BUDGET}, texts as (select query_id, string_agg(rendered, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by order_no) filter (fits) as context_text, string_agg(chunk_ids, ',' order by order_no) filter (fits) as included,
      coalesce(string_agg(chunk_ids, ',' order by k desc) filter (not fits), '') as dropped from kept group by 1)
      select query_id, greatest(1, floor({words("context_text")} * 1.3::double)::int) as total_tokens, context_text, included, dropped from texts""",
    "groundedness": f"""with {GROUND} select "case", refused or (len(bad) = 0 and len(weak) = 0 and len(strange) = 0) as passed, refused as is_insufficient_evidence,
      case when refused then '' else array_to_string(weak, ' | ') end as unsupported_sentences, case when refused then '' else array_to_string(bad, ' | ') end as bad_citations, case when refused then '' else array_to_string(strange, ' | ') end as unsupported_numbers,
      case when refused or len(full_c) = 0 then 1 else 0 end as n_notes from c3""",
    "mock_answers": f"with {EXTRACT} select query_id, case when n > 0 then x.s || ' ' || x.c else '{NOTHING_FOUND}' end as answer from b",
    "rag_rollup": f"""with {values("r", "category, cp, cr, rel, faith, corr, handled, answerable, source, passed", fx.ROLLUP_ROWS)}
      select category, round(avg(cp), 6) as context_precision, round(avg(cr), 6) as context_recall, round(avg(rel), 6) as answer_relevance, round(avg(faith), 6) as faithfulness, round(avg(corr), 6) as answer_correctness,
        round(avg(handled::int), 6) as answerability_accuracy, count(*) filter (answerable and source <> 'answered') as wrongly_refused, count(*) filter (answerable and source = 'gate_refusal') as wrongly_refused_by_gate,
        count(*) filter (answerable and source = 'llm_refusal') as wrongly_refused_by_llm, round(coalesce(avg(corr) filter (answerable and source = 'answered'), 0), 6) as correctness_when_answered, round(avg(passed::int), 6) as groundedness_pass_rate, count(*) as n
      from r group by rollup(category)""",
    "slugs": r"with raw(name) as (values ('Boat Lease (2024)'), ('--a  b--'), ('Äpfel & Co.')) select name, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]', '-', 'g'), '-') as slug from raw",
}
