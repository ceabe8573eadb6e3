"""Small inline documents and cases for queries and tests; the texts are made up for this purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio import schemas

DOC, NAME = "lease", "Boat Lease"
TITLE, HEAD, BODY = 18.0, 12.5, 10.0

#: (page, height, font size, bold, text)
CONTRACT = (
    (1, 20.0, 9.0, False, "Boat Lease - page 1 of 4"),
    (1, 60.0, TITLE, True, "BOAT LEASE AGREEMENT"),
    (1, 90.0, BODY, False, "Signed between Harbour House and Reed Ferries."),
    (1, 130.0, HEAD, True, "1. Definitions"),
    (1, 150.0, BODY, False, "The Lessor is Harbour House and the Lessee is Reed Ferries."),
    (1, 165.0, BODY, False, "A Vessel is any boat listed in the annex to this lease."),
    (1, 200.0, HEAD, True, "2. Term"),
    (1, 220.0, BODY, False, "The lease runs for 36 months from the first day of May."),
    (1, 780.0, 9.0, False, "Confidential - copy 11"),
    (2, 20.0, 9.0, False, "Boat Lease - page 2 of 4"),
    (2, 60.0, HEAD, True, "3. Payment"),
    (2, 80.0, BODY, False, "Fees fall due as set out below, subject to Sections 4, 5.1"),
    (2, 95.0, BODY, False, "and 6 of this lease."),
    (2, 120.0, HEAD, True, "3.1 Fees"),
    (2, 140.0, BODY, False, "The Lessee pays a monthly fee for each Vessel by its class."),
    (2, 260.0, BODY, False, "A late fee of 1.5% is charged after 30 days."),
    (2, 300.0, HEAD, True, "3.2 Invoices"),
    (2, 320.0, BODY, False, "The Lessor sends an invoice on the last day of each month."),
    (2, 335.0, BODY, False, "A disputed invoice is notified within 14 days under Section 6."),
    (2, 780.0, 9.0, False, "Confidential - copy 12"),
    (3, 20.0, 9.0, False, "Boat Lease - page 3 of 4"),
    (3, 60.0, HEAD, True, "4. Termination"),
    (3, 80.0, BODY, False, "Either party may end this lease as follows."),
    (3, 110.0, HEAD, True, "4.2 Termination for cause"),
    (3, 130.0, BODY, False, "The Lessor may terminate for cause when a fee stays unpaid for 60 days, see Section 3.1."),
    (3, 160.0, HEAD, True, "4.2.1 Notice of cause"),
    (3, 180.0, BODY, False, "Notice of termination for cause names the breach and leaves 10 days to cure it."),
    (3, 210.0, HEAD, True, "5.1.1 Insurance"),
    (3, 230.0, BODY, False, "The Lessee insures each Vessel for $250,000 at least."),
    (3, 780.0, 9.0, False, "Confidential - copy 13"),
    (4, 20.0, 9.0, False, "Boat Lease - page 4 of 4"),
    (4, 60.0, HEAD, True, "6. Notices"),
    (4, 80.0, BODY, False, "Notices are sent in writing to the address in the annex."),
    (4, 95.0, BODY, False, "6.1 A notice by post counts as given after 3 days."),
    (4, 110.0, BODY, False, "6.2 A notice by hand counts at once; see Section 9."),
    (4, 780.0, 9.0, False, "Confidential - copy 14"),
)
#: (page, height, headers, rows)
CONTRACT_TABLES = ((2, 155.0, ["Class", "Length", "Monthly fee"], [["A", "under 8 m", "$400"], ["B", "8 to 12 m", "$900"]]), (2, 155.0, [], [["Deposit", "$1,000"]]))

#: (id, category, question, keyword groups, answerable)
CONTRACT_QUESTIONS = (
    ("q1", "simple_factual", "How long does the lease run?", [["36 months"]], True),
    ("q2", "section_specific", "What does Section 4.2 say about termination for cause?", [["terminate for cause"]], True),
    ("q3", "table", "What is the monthly fee of each vessel class?", [["$400", "$900"]], True),
    ("q4", "multi_hop", "Compare payment of a disputed invoice and the notice period.", [["disputed invoice"], ["counts as given"]], True),
    ("q5", "no_answer", "Who employs qualified crew during winter storage?", [], False),
    ("q6", "cross_reference", "When may the lessor terminate if a fee is unpaid?", [["unpaid for 60 days"]], True),
)

#: Headings and lines that only look like them: (text, font size, bold)
HEADING_CASES = (
    ("2025 2024", 10.0, True), ("$3.75B", 16.0, True), ("Article 4", 10.0, True), ("Article 5", 10.3, False), ("1730 Main Road", 10.0, True), ("1st Street", 10.0, True), ("1.", 10.0, True),
    ("7.3 " + "word " * 20 + "end", 10.0, True), ("4.4 plain numbered line", 10.0, False), ("GENERAL TERMS", 12.0, False), ("TERMS 2024", 12.0, False), ("3.2.1 - Deep title", 11.0, False), ("Mixed Case", 14.0, True),
)
#: (page, top, x0, size, font, text); one line slopes down two units a word.
WORD_BOXES = (
    (1, 10.0, 0.0, 10.0, "Serif-Bold", "A"), (1, 12.0, 10.0, 10.0, "Serif", "slanting"), (1, 14.0, 20.0, 11.0, "Serif", "line"), (1, 30.04, 5.0, 10.0, "Serif", "next"), (1, 30.0, 1.0, 10.0, "Serif", "The"),
    (1, 50.0, 50.0, 9.0, "Serif", "cell"), (1, 70.0, 1.0, 9.0, "Serif", "tail"), (2, 10.0, 1.0, 12.0, "Sans-BOLD", "Page"), (2, 10.2, 9.0, 12.0, "Sans", "two"),
)
TABLE_BOXES = ((1, 45.0, 45.0, 90.0, 55.0),)
REFERENCE_CASES = ("see Section 4.2 and Sections 3, 5, 10 and 12", "sections 1.2.3(a), 2 & 9 apply", "Section 6.2(b)", "no reference to subsection", "", "SECTION 4", "under section 7.1. Section 7.1 again")
CLAUSE_CASES = (("n1", "Opening line\ngoes on\n1.1 First clause\nwith more\n1.2. Second\n\n2 not dotted"), ("n2", "3.1 At once\n3.2 Then"), ("n3", "  \n"), ("n4", ""))

#: (query, document, source, chunk, score, rank)
FUSION_HITS = (
    ("a", "d", "vector", "c1", 0.9, 1), ("a", "d", "vector", "c2", 0.5, 2), ("a", "d", "vector", "c3", 0.5, 3), ("a", "d", "lexical", "c2", 4.0, 1), ("a", "d", "lexical", "c4", 1.0, 2), ("a", "d", "hierarchy", "c2", 10.0, 1),
    ("b", "d", "vector", "c3", 0.0, 1), ("b", "d", "vector", "c4", 0.0, 2), ("b", "d", "lexical", "c5", 2.0, 1), ("b", "d", "hierarchy", "c5", 3.0, 1), ("b", "d", "hierarchy", "c1", 1.0, 2),
)
#: (document, chunk, number, node, section, refs, table)
FUSION_CHUNKS = (
    ("d", "c1", 1, "n1", "1", ["2", "10", "9"], None), ("d", "c2", 2, "n2", "2", [], None), ("d", "c3", 3, "n3", "3", ["2", "3"], None), ("d", "c4", 4, "n4", None, [], None), ("d", "c5", 5, "n5", "5", ["10"], None),
    ("d", "c6", 6, "n6", "10", [], None), ("d", "c7", 7, "n6", "10", [], None), ("d", "c8", 8, "n7", "10", [], None), ("d", "t1", 9, "n2", "2", [], "tbl"),
)
#: (document, node, number, section)
FUSION_NODES = (("d", "n1", 1, "1"), ("d", "n2", 2, "2"), ("d", "n3", 3, "3"), ("d", "n4", 4, None), ("d", "n5", 5, "5"), ("d", "n6", 6, "10"), ("d", "n7", 7, "10"))
FUSION_QUERIES = (("a", ["2"]), ("b", []))
#: Reranked chunks: (query, document, number, chunk, node, section, title, parent, page from, to, score, text)
CONTEXT_ROWS = (
    ("a", "d", 1, "c1", "n1", "10", "Ten", None, 3, 3, 0.9, "tenth section words one two three four five six"),
    ("a", "d", 2, "c2", "n2", "2", "Two", "Part", 3, 4, 0.5, "second section first chunk with words and words"),
    ("a", "d", 3, "c3", "n2", "2", "Two", "Part", 2, 2, 0.4, "second section other chunk"),
    ("a", "d", 4, "c4", "n3", None, "Loose", None, 1, 1, 0.5, "a loose block that has no number"),
    ("a", "d", 5, "c5", "n2", "2", "Two", "Part", 5, 5, 0.3, "second section first chunk with words and words"),
    ("b", "d", 1, "c9", "n9", "9", None, None, 7, 8, 0.2, "only block " + "and more of it " * 30),
)
#: (case, answer) against one context.
ANSWER_CASES = (
    ("grounded", "The lease runs for 36 months from May. [Source: Boat Lease, Section 2, Page 1]"),
    ("by_section", "The lease runs for 36 months from May. [Source: Boat Lease, Section 2]"),
    ("invented_section", "The lease runs for 36 months. [Source: Boat Lease, Section 99]"),
    ("invented_figure", "The lease runs for 48 months. [Source: Boat Lease, Section 2, Page 1]"),
    ("no_citation", "The lease runs for 36 months from May."),
    ("off_topic", "Penguins swim around colourful icebergs happily; the lease runs for 36 months. [Source: Boat Lease, Section 2, Page 1]"),
    ("single_digit", "The lease runs for 36 months in 7 parts. [Source: Boat Lease, Section 2, Page 1]"),
    ("refusal", "  insufficient evidence: nothing is said."),
    ("comma_number", "The lease costs $250,000 for 36 months. [Source: Boat Lease, Section 2, Page 1]"),
)
ANSWER_BLOCKS = (("Boat Lease", "2", "Term", "The lease runs for 36 months from the first day of May; it costs $250000.", "[Source: Boat Lease, Section 2, Page 1]"), ("Boat Lease", None, "Annex", "Boats of class A. Boats of class B; and no other boats.", "[Source: Boat Lease, Page 4]"))
EXTRACT_QUESTIONS = (("x1", "How many months does the lease run?"), ("x2", "Which boats of class B?"), ("x3", "zebra quantum"), ("x4", ""))
#: (category, precision, recall, relevance, faithful, correctness, handled, answerable, source, passed)
ROLLUP_ROWS = (
    ("table", 0.5, 1.0, 0.25, 1.0, 1.0, True, True, "answered", True), ("table", 0.0, 0.0, 0.5, 1.0, 0.0, False, True, "gate_refusal", True), ("no_answer", 0.0, 0.0, 0.0, 1.0, 0.0, True, False, "llm_refusal", True),
    ("multi_hop", 0.25, 1.0, 0.75, 1.0, 0.5, True, True, "answered", True), ("multi_hop", 0.75, 1.0, 0.1, 1.0, 0.0, False, True, "llm_refusal", False),
)


def contract_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DOC, NAME, k, page, y, size, bold, text) for k, (page, y, size, bold, text) in enumerate(CONTRACT, 1)], schemas.LINES)


def contract_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DOC, f"{DOC}-tbl-{k}", k, page, y, headers, rows) for k, (page, y, headers, rows) in enumerate(CONTRACT_TABLES, 1)], schemas.TABLES)


def contract_questions(spark: SparkSession) -> DataFrame:
    rows = [(q, c, text, groups, answerable, "", "") for q, c, text, groups, answerable in CONTRACT_QUESTIONS]
    return spark.createDataFrame(rows, "query_id string, category string, question string, groups array<array<string>>, is_answerable boolean, expected_answer string, notes string")
