"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each string runs in DuckDB against views named after the test tables. Fragments are
shared through Python string composition; the SQL is written from the query's meaning,
not generated from the Spark plan. Conventions shared with the Spark side: money is
summed as decimal and cast to double after the sum; derived doubles are rounded to 6
decimals half-up through a decimal (which also turns -0.0 into 0.0, as Spark does).
"""

from __future__ import annotations

# Spark rounds a double half-up on its decimal form; DuckDB's double round differs on exact
# binary ties (x/32), so the oracle rounds through a decimal. +-Inf and NaN pass through.
R6 = "(CASE WHEN isfinite({x}) THEN CAST(round(CAST({x} AS DECIMAL(38,12)), 6) AS DOUBLE) ELSE {x} END)"


def r6(expr: str, alias: str | None = None) -> str:
    out = R6.format(x=expr)
    return f"{out} AS {alias or expr}"


# ------------------------------------------------------------------ trade fixture

REPORTER_KEY = 3
REPORTER = "NATION_3"
BASE_YEAR = 1995

ORD = """
ord AS (
  SELECT o.o_orderkey, o.o_custkey, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         c.c_nationkey AS m, c.c_mktsegment, o.o_orderstatus, o.o_orderpriority,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

TRADE_WORLD = ORD + f""",
flows AS (
  SELECT ord.year, s.s_nationkey AS x, ord.m, l.l_returnflag AS rf,
         SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS v,
         SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS q
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN ord ON l.l_orderkey = ord.o_orderkey
  GROUP BY ord.year, s.s_nationkey, ord.m, l.l_returnflag),
gdp AS (
  SELECT m, year,
         CAST(SUM(CASE WHEN o_orderstatus IN ('F', 'P') THEN price END) AS DOUBLE) AS cons_final,
         CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN price END) AS DOUBLE) AS gfcf_final
  FROM ord GROUP BY m, year),
trade AS (
  SELECT nation AS m, year,
    CAST(SUM(CASE WHEN side = 'imp' AND rf <> 'R' THEN v END) AS DOUBLE) AS cons_final_nominal,
    CAST(SUM(CASE WHEN side = 'imp' AND rf = 'R' THEN v END) AS DOUBLE) AS gfcf_final_nominal,
    CAST(SUM(CASE WHEN side = 'exp' THEN v END) AS DOUBLE) AS nom_exports_dom,
    CAST(SUM(CASE WHEN side = 'imp' THEN v END) AS DOUBLE) AS nom_imports_dom,
    CAST(SUM(CASE WHEN side = 'exp' THEN q END) AS DOUBLE) AS real_exports,
    CAST(SUM(CASE WHEN side = 'imp' THEN q END) AS DOUBLE) AS real_imports
  FROM (SELECT m AS nation, 'imp' AS side, * FROM flows
        UNION ALL SELECT x AS nation, 'exp' AS side, * FROM flows) sides
  GROUP BY nation, year),
code_list AS (
  SELECT CASE WHEN n_name <> 'NATION_24' THEN 'Z' || chr(65 + n_nationkey::INTEGER) END AS iso2c,
         'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS partner_iso FROM nation),
code_file AS (
  SELECT n_name AS country,
         upper(CASE WHEN n_name = 'NATION_9' THEN 'x99' ELSE 'n' || lpad(n_nationkey::VARCHAR, 2, '0') END) AS partner_iso
  FROM nation WHERE n_name <> 'NATION_5'),
codes AS (
  SELECT f.country, f.partner_iso, c.iso2c
  FROM (SELECT * FROM code_list WHERE iso2c IS NOT NULL) c RIGHT JOIN code_file f ON c.partner_iso = f.partner_iso),
accounts AS (
  SELECT n.n_name AS country, g.m, g.year, g.cons_final, g.gfcf_final, t.cons_final_nominal, t.gfcf_final_nominal,
         t.nom_exports_dom, t.nom_imports_dom, t.real_exports, t.real_imports
  FROM gdp g LEFT JOIN trade t ON g.m = t.m AND g.year = t.year JOIN nation n ON g.m = n.n_nationkey),
w0 AS (
  SELECT a.*, CASE WHEN a.country = 'NATION_5' THEN 'N05' ELSE c.partner_iso END AS partner_iso,
         CASE WHEN a.country = 'NATION_5' THEN 'ZF' ELSE c.iso2c END AS iso2c
  FROM codes c RIGHT JOIN accounts a ON c.country = a.country),
series AS (
  SELECT f.year, k.iso2c, CAST(SUM(f.v) AS DOUBLE) AS exports_by_reporter
  FROM flows f JOIN (SELECT DISTINCT m, iso2c FROM w0 WHERE iso2c IS NOT NULL) k ON f.m = k.m
  WHERE f.x = {REPORTER_KEY} AND f.m <> {REPORTER_KEY} GROUP BY f.year, k.iso2c),
world AS (
  SELECT w0.year, w0.country, w0.m AS nation_key, w0.partner_iso, w0.iso2c, w0.cons_final, w0.gfcf_final,
         w0.cons_final_nominal, w0.gfcf_final_nominal, w0.nom_exports_dom, w0.nom_imports_dom,
         w0.real_exports, w0.real_imports, s.exports_by_reporter, r.total_exports
  FROM w0 LEFT JOIN series s ON w0.year = s.year AND w0.iso2c = s.iso2c
  LEFT JOIN (SELECT year, nom_exports_dom AS total_exports FROM w0 WHERE m = {REPORTER_KEY}) r ON w0.year = r.year)"""


def lag_t(x: str, unit: str = "country", time: str = "year") -> str:
    """Time-aware lag by one period within the unit."""
    w = f"OVER (PARTITION BY {unit} ORDER BY {time})"
    return f"(CASE WHEN lag({time}) {w} = {time} - 1 THEN lag({x}) {w} END)"


def guard(expr: str, base: int = BASE_YEAR) -> str:
    return f"(CASE WHEN year = {base} THEN NULL ELSE {expr} END)"


TRADE_PANEL = TRADE_WORLD + f""",
p1 AS (
  SELECT *,
    {guard(f"(cons_final - {lag_t('cons_final')}) / {lag_t('cons_final')}")} AS C,
    {guard(f"(gfcf_final - {lag_t('gfcf_final')}) / {lag_t('gfcf_final')}")} AS I,
    {guard(f"{lag_t('cons_final_nominal')} / ({lag_t('cons_final_nominal')} + {lag_t('gfcf_final_nominal')})")} AS s_C,
    {guard(f"{lag_t('exports_by_reporter')} / {lag_t('total_exports')}")} AS w,
    cons_final + gfcf_final AS DA_level
  FROM world),
p2 AS (SELECT *, {guard('1.0 - s_C')} AS s_I FROM p1),
p3 AS (
  SELECT *, C * s_C + I * s_I AS DA_growth,
         max(CASE WHEN year = {BASE_YEAR} THEN DA_level END) OVER (PARTITION BY country) AS baseDA,
         max(CASE WHEN year = {BASE_YEAR} THEN 1 END) OVER (PARTITION BY country) AS has_base
  FROM p2),
panel AS (SELECT * EXCLUDE (has_base), 100.0 * DA_level / baseDA AS DA_index FROM p3 WHERE has_base = 1),
fa0 AS (
  SELECT year, SUM(w * DA_growth) AS FA_components FROM panel
  WHERE w * DA_growth IS NOT NULL AND NOT isnan(w * DA_growth) GROUP BY year),
fa AS (
  SELECT year, FA_components,
         product(1 + FA_components) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100 AS FA
  FROM fa0)"""

TRADE_REPORTER = TRADE_PANEL + f""",
rep0 AS (
  SELECT p.year, p.country, p.cons_final, p.cons_final_nominal, p.gfcf_final_nominal, p.gfcf_final,
         p.nom_exports_dom, p.nom_imports_dom, p.real_exports, p.real_imports, p.DA_index,
         fa.FA_components, CASE WHEN p.year = {BASE_YEAR} THEN 100.0 ELSE fa.FA END AS FA
  FROM panel p LEFT JOIN fa ON p.year = fa.year WHERE p.country = '{REPORTER}'),
rep1 AS (
  SELECT *, nom_exports_dom / nom_imports_dom AS TR, FA / DA_index AS RA,
         real_exports / FA AS FMI, real_imports / DA_index AS DMI FROM rep0),
rep2 AS (SELECT *, FMI / DMI AS RMI, TR * (real_imports / real_exports) AS R FROM rep1),
reporter AS (
  SELECT *, ln(RA) AS log_RA, ln(TR) AS log_TR, ln(R) AS log_R, ln(RMI) AS log_RMI,
         ln(DMI) AS log_DMI, ln(FMI) AS log_FMI, ln(DA_index) AS log_DA, ln(FA) AS log_FA
  FROM rep2)"""

DECOMP_COLS = ["FA_components", "FA", "DA_index", "TR", "RA", "FMI", "DMI", "RMI", "R",
               "log_RA", "log_TR", "log_R", "log_RMI", "log_DMI", "log_FMI", "log_DA", "log_FA"]

ORACLE: dict[str, str] = {}

ORACLE["trade_panel"] = "WITH " + TRADE_WORLD + """
SELECT year, country, nation_key, partner_iso, iso2c, """ + ", ".join(r6(c) for c in [
    "cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal", "nom_exports_dom",
    "nom_imports_dom", "real_exports", "real_imports", "exports_by_reporter", "total_exports"]) + """
FROM world"""

ORACLE["absorption_index"] = "WITH " + TRADE_PANEL + """
SELECT year, country, """ + ", ".join(r6(c) for c in [
    "C", "I", "s_C", "s_I", "DA_growth", "DA_level", "baseDA", "DA_index"]) + """
FROM panel"""

ORACLE["foreign_demand_index"] = "WITH " + TRADE_PANEL + """
SELECT year, """ + r6("FA_components") + ", " + r6("FA") + " FROM fa"

ORACLE["trade_decomposition"] = "WITH " + TRADE_REPORTER + """
SELECT year, country, """ + ", ".join(r6(c) for c in DECOMP_COLS) + " FROM reporter"

ORACLE["decomp_long"] = "WITH " + TRADE_REPORTER + """,
wide AS (
  SELECT year,
    ln(R / first_value(R) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ToT,
    ln(RA / first_value(RA) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS Exp,
    ln(TR / first_value(TR) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS Tratio,
    ln(RMI / first_value(RMI) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS switch
  FROM reporter)
SELECT year, name, """ + r6("value") + """
FROM (SELECT year, 'ToT' AS name, ToT AS value FROM wide
      UNION ALL SELECT year, 'Exp', Exp FROM wide
      UNION ALL SELECT year, 'Tratio', Tratio FROM wide
      UNION ALL SELECT year, 'switch', switch FROM wide)"""

ORACLE["decomp_periods"] = "WITH " + TRADE_REPORTER + """,
periods AS (SELECT * FROM (VALUES (1995, 1997), (1998, 2000)) v(start_y, end_y))
SELECT CAST(p.start_y AS VARCHAR) || '-' || CAST(p.end_y AS VARCHAR) AS period,
  """ + ",\n  ".join([
    r6("(e.log_R - s.log_R) * 100", "R"),
    r6("(e.log_TR - s.log_TR) * 100", "TR"),
    r6("(e.log_FA - s.log_FA) * 100", "FA"),
    r6("-((e.log_DA - s.log_DA) * 100)", "DA"),
    r6("(e.log_FMI - s.log_FMI) * 100", "FMI"),
    r6("-((e.log_DMI - s.log_DMI) * 100)", "DMI"),
]) + """
FROM periods p LEFT JOIN reporter s ON s.year = p.start_y LEFT JOIN reporter e ON e.year = p.end_y"""


# ------------------------------------------------------------------ corpus statistics

# The oracle's own token pattern and lists, so that a fault in the package's shows.
TOKEN = (r"(?:\p{Nd}+(?:[.,;']\p{Nd}+)*"            # digit runs joined by . , ; '
         r"|[\p{L}\p{M}]+(?:['’.:·][\p{L}\p{M}]+)*"   # letter runs joined by ' ’ . : ·
         r"|_)+")
CUSTOM = """2 4 100 1000 8 10 720 1883 1878 1873 1880 1879 0 1882 1884 pp 4_i 4_l 100_l 1000_l 8_s 720_s
10_s 3_l 720_l 10,000_l 50_l _on metamorphosis tokens qrs 5_l 2000_l 5000_l whilst laborers labourers
8_d g etc l 20,000_l ..a... 1870 8vo 900_l 9_s 4_s 2_s 200_l 1,000 laboring laborer labourer
the der les und que""".split()
ENGLISH = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're
he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would""".split()


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _word_values(words) -> str:
    return "(VALUES " + ", ".join(f"({_sql_str(w)})" for w in sorted({w.lower() for w in words})) + ") v(word)"


TOK_SQL = _sql_str(TOKEN)

TEXT = f"""
docs AS (SELECT doc_id, lang AS author, source, text FROM documents),
tok AS (SELECT doc_id, author, unnest(regexp_extract_all(lower(text), {TOK_SQL}, 0)) AS word FROM docs),
counts AS (SELECT author, word, count(*) AS n FROM tok GROUP BY author, word),
totals AS (SELECT author, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY author),
wt AS (SELECT c.author, c.word, c.n, t.total FROM counts c LEFT JOIN totals t ON c.author = t.author),
zipf AS (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, word) AS rank,
         n / total AS term_frequency FROM wt),
dfreq AS (SELECT word, count(*) AS df FROM counts GROUP BY word),
ndocs AS (SELECT count(DISTINCT author) AS nd FROM counts),
tfidf AS (
  SELECT c.author, c.word, c.n, c.n / t.total AS tf, ln(nd / df) AS idf, (c.n / t.total) * ln(nd / df) AS tf_idf
  FROM counts c JOIN totals t ON c.author = t.author JOIN dfreq f ON c.word = f.word, ndocs),
cleaned AS (SELECT * FROM tfidf WHERE word NOT IN (SELECT word FROM {_word_values(CUSTOM)})),
top15 AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY author ORDER BY tf_idf DESC) AS rk FROM cleaned) WHERE rk <= 15),
kept AS (SELECT * FROM tok WHERE word NOT IN (SELECT word FROM {_word_values(ENGLISH)})),
kcounts AS (SELECT author, word, count(*) AS n FROM kept GROUP BY author, word)"""

ORACLE["corpus_scan"] = f"WITH {TEXT} SELECT doc_id, author, source, CAST(length(text) AS BIGINT) AS text_chars FROM docs WHERE author IN ('en', 'fr', 'de')"
ORACLE["tokenize_words"] = f"""WITH {TEXT},
arr AS (SELECT doc_id, author, regexp_extract_all(lower(text), {TOK_SQL}, 0) AS t FROM docs)
SELECT doc_id, author, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_types,
       CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS token_chars FROM arr"""
ORACLE["tokenize_uax29"] = f"""WITH {TEXT},
arr AS (SELECT doc_id, author, list_filter(regexp_extract_all(lower(text), {TOK_SQL}, 0),
               lambda w: regexp_matches(w, '[^_]')) AS t FROM docs)
SELECT doc_id, author, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_types,
       md5(coalesce(array_to_string(t, chr(10)), '')) AS words_md5 FROM arr"""
ORACLE["word_counts"] = f"WITH {TEXT} SELECT author, word, n, row_number() OVER (ORDER BY n DESC, author, word) AS position FROM counts"
ORACLE["word_totals"] = f"WITH {TEXT} SELECT author, word, n, total FROM wt"
ORACLE["zipf_rank"] = f"WITH {TEXT} SELECT author, word, n, total, rank, {r6('term_frequency')} FROM zipf"
ORACLE["zipf_loglog"] = f"""WITH {TEXT} SELECT author, word, rank, {r6('log10(rank)', 'log_rank')},
  {r6('log10(term_frequency)', 'log_tf')} FROM zipf"""
ORACLE["tf_idf"] = f"WITH {TEXT} SELECT author, word, n, {r6('tf')}, {r6('idf')}, {r6('tf_idf')} FROM tfidf"
ORACLE["stopword_antijoin_custom"] = f"WITH {TEXT} SELECT author, word, n, {r6('tf')}, {r6('idf')}, {r6('tf_idf')} FROM cleaned"
ORACLE["tfidf_top_terms"] = f"WITH {TEXT} SELECT author, word, n, {r6('tf_idf')} FROM top15"
ORACLE["topk_ties"] = f"""WITH {TEXT} SELECT author, word, n FROM
  (SELECT *, rank() OVER (PARTITION BY author ORDER BY n DESC) AS rk FROM counts) WHERE rk <= 200"""
ORACLE["label_reorder"] = f"""WITH {TEXT},
means AS (SELECT word, avg(tf_idf) AS word_level_mean FROM top15 GROUP BY word),
lv AS (SELECT word, word_level_mean, row_number() OVER (ORDER BY word_level_mean, word) AS word_level FROM means)
SELECT t.author, t.word, {r6('t.tf_idf', 'tf_idf')}, {r6('lv.word_level_mean', 'word_level_mean')}, lv.word_level,
       t.word || '___' || t.author AS word_in_author,
       row_number() OVER (PARTITION BY t.author ORDER BY t.tf_idf, t.word) AS word_in_author_place
FROM top15 t LEFT JOIN lv ON t.word = lv.word"""
ORACLE["tf_idf_by_source"] = f"""WITH
tok AS (SELECT source AS author, unnest(regexp_extract_all(lower(text), {TOK_SQL}, 0)) AS word FROM documents),
counts AS (SELECT author, word, count(*) AS n FROM tok GROUP BY author, word),
dfreq AS (SELECT word, count(*) AS df FROM counts GROUP BY word),
x AS (
  SELECT c.author, c.n, ln((SELECT count(DISTINCT author) FROM counts) / df) AS idf,
         c.n / sum(c.n) OVER (PARTITION BY c.author) AS tf
  FROM counts c JOIN dfreq USING (word))
SELECT author, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens, {r6('sum(tf * idf)', 'tf_idf_sum')},
       {r6('max(idf)', 'idf_max')} FROM x GROUP BY author"""
ORACLE["stopword_antijoin_builtin"] = f"WITH {TEXT} SELECT doc_id, author, count(*) AS n_kept FROM kept GROUP BY doc_id, author"
ORACLE["topic_word_counts"] = f"WITH {TEXT} SELECT author, word, n FROM kcounts"
ORACLE["dtm_stats"] = f"""WITH {TEXT}
SELECT author, count(*) AS nnz, CAST(sum(n) AS DOUBLE) AS row_sum,
       (SELECT count(DISTINCT word) FROM kcounts) AS n_terms
FROM kcounts GROUP BY author"""

ENTRIES = TEXT + """,
dcounts AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM kept GROUP BY doc_id, word),
di AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM (SELECT DISTINCT doc_id FROM dcounts)),
ti AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS term_index FROM (SELECT DISTINCT word FROM dcounts)),
entries AS (SELECT doc_id, doc_index, word, term_index, n FROM dcounts JOIN di USING (doc_id) JOIN ti USING (word))"""


def _weight(name: str, i: int) -> str:
    return f"('0x' || substr(md5(CAST({name} AS VARCHAR) || '#{i}'), 1, 4))::BIGINT::DOUBLE / 65536"


ORACLE["dtm_blocks"] = f"""WITH {ENTRIES}
SELECT doc_index // 64 AS row_block, term_index // 128 AS col_block, count(DISTINCT doc_index) AS n_rows, count(*) AS nnz,
       CAST(sum(n) AS DOUBLE) AS total FROM entries GROUP BY 1, 2"""
ORACLE["dtm_block_margins"] = f"""WITH {ENTRIES}
SELECT 'document' AS axis, doc_index AS "index", CAST(sum(n) AS DOUBLE) AS total FROM entries GROUP BY doc_index
UNION ALL SELECT 'term', term_index, CAST(sum(n) AS DOUBLE) FROM entries GROUP BY term_index"""
ORACLE["dtm_block_product"] = f"""WITH {ENTRIES}
SELECT doc_index, {r6(f"sum(n * ({_weight('word', 1)}))", 'y1')}, {r6(f"sum(n * ({_weight('word', 2)}))", 'y2')}
FROM entries GROUP BY doc_index"""
ORACLE["dtm_block_product_t"] = f"""WITH {ENTRIES}
SELECT term_index, {r6(f"sum(n * ({_weight('doc_id', 1)}))", 'y1')} FROM entries GROUP BY term_index"""


def topics_sql(steps: int, k: int = 4, alpha: float = 0.1, eta: float = 0.01) -> str:
    """CTEs of ``steps`` rounds of the topic fit; the last word weights are w{steps}."""
    ks = range(1, k + 1)
    cols = lambda f: ", ".join(f(i) for i in ks)
    out = [TEXT, "tc AS MATERIALIZED (SELECT * FROM kcounts)", """h AS (SELECT word, """ + cols(
        lambda i: f"('0x' || substr(md5(word || '#{i}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS a{i}")
        + " FROM (SELECT DISTINCT word FROM tc))",
        "w0 AS MATERIALIZED (SELECT word, " + cols(lambda i: f"a{i} / (SELECT sum(a{i}) FROM h) AS w{i}") + " FROM h)",
        "t0 AS MATERIALIZED (SELECT DISTINCT author, " + cols(lambda i: f"{1 / k}::DOUBLE AS t{i}") + " FROM tc)"]
    total = " + ".join(f"w{i} * t{i}" for i in ks)
    for s in range(steps):
        out += [
            f"j{s} AS MATERIALIZED (SELECT author, word, " + cols(lambda i: f"n * w{i} * t{i} / ({total}) AS a{i}")
            + f" FROM tc JOIN w{s} USING (word) JOIN t{s} USING (author))",
            f"nw{s} AS MATERIALIZED (SELECT word, " + cols(lambda i: f"sum(a{i}) + {eta} AS a{i}") + f" FROM j{s} GROUP BY word)",
            f"nt{s} AS (SELECT author, " + cols(lambda i: f"sum(a{i}) + {alpha} AS a{i}") + f" FROM j{s} GROUP BY author)",
            f"w{s + 1} AS MATERIALIZED (SELECT word, " + cols(lambda i: f"a{i} / (SELECT sum(a{i}) FROM nw{s}) AS w{i}") + f" FROM nw{s})",
            f"t{s + 1} AS MATERIALIZED (SELECT author, " + cols(lambda i: f"a{i} / ({' + '.join(f'a{x}' for x in ks)}) AS t{i}") + f" FROM nt{s})"]
    beta = " UNION ALL ".join(f"SELECT {i} AS topic, word AS term, w{i} AS beta FROM w{steps}" for i in ks)
    return "WITH " + ",\n".join(out) + f",\nbeta AS ({beta})\n"


ORACLE["topic_em_step"] = topics_sql(1) + f"SELECT topic, term, {r6('beta')} FROM beta"


def vem_sql(steps: int, k: int = 4, inner: int = 2, tolerance: float = 1e-4) -> str:
    """CTEs of ``steps`` rounds of the variational fit: word weights w{s}, document parameters g{s},
    the bound of each round, and the first round where it has settled."""
    ks, alpha = range(1, k + 1), 50.0 / k
    cols = lambda f, sep=", ": sep.join(f(i) for i in ks)

    def psi(x):
        y = f"({x} + 20.0)"
        return (f"(ln({y}) - 0.5 / {y} - 1.0 / (12.0 * {y} ** 2) + 1.0 / (120.0 * {y} ** 4) - 1.0 / (252.0 * {y} ** 6) - ("
                + " + ".join(f"1.0 / ({x} + {i}.0)" for i in range(20)) + "))")

    out = [TEXT, "tc AS MATERIALIZED (SELECT * FROM kcounts)", "h AS (SELECT word, " + cols(
        lambda i: f"('0x' || substr(md5(word || '#{i}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS a{i}")
        + " FROM (SELECT DISTINCT word FROM tc))",
        "w0 AS MATERIALIZED (SELECT word, " + cols(lambda i: f"a{i} / (SELECT sum(a{i}) FROM h) AS w{i}") + " FROM h)",
        f"g0 AS MATERIALIZED (SELECT author, {cols(lambda i: f'{alpha} + sum(n)::DOUBLE / {k} AS g{i}')} FROM tc GROUP BY author)"]
    whole = cols(lambda i: f"g{i}", " + ")
    shares = cols(lambda i: f"w{i} * t{i}", " + ")

    def weights(name, of):
        return (f"{name} AS MATERIALIZED (SELECT author, " + cols(lambda i: f"{psi(f'g{i}')} - p AS l{i}, exp({psi(f'g{i}')} - p) AS t{i}, g{i}")
                + f" FROM (SELECT *, {psi(f'({whole})')} AS p FROM {of}))")

    for s in range(steps):
        last = f"g{s}"
        for r in range(inner):
            out += [weights(f"t{s}_{r}", last),
                    f"x{s}_{r} AS MATERIALIZED (SELECT author, " + cols(lambda i: f"{alpha} + sum(n * w{i} * t{i} / ({shares})) AS g{i}")
                    + f" FROM tc JOIN w{s} USING (word) JOIN t{s}_{r} USING (author) GROUP BY author)"]
            last = f"x{s}_{r}"
        out += [f"g{s + 1} AS (SELECT * FROM {last})", weights(f"e{s + 1}", last),
                f"j{s} AS MATERIALIZED (SELECT word, sum(n * ln({shares})) AS ll, " + cols(lambda i: f"sum(n * w{i} * t{i} / ({shares})) AS a{i}")
                + f" FROM tc JOIN w{s} USING (word) JOIN e{s + 1} USING (author) GROUP BY word)",
                f"b{s + 1} AS MATERIALIZED (SELECT (SELECT sum(ll) FROM j{s}) + sum(lgamma({k * alpha}) - {k} * lgamma({alpha}) + "
                + cols(lambda i: f"lgamma(g{i}) + ({alpha} - g{i}) * l{i}", " + ") + f" - lgamma({whole})) AS v FROM e{s + 1})",
                f"w{s + 1} AS MATERIALIZED (SELECT word, " + cols(lambda i: f"a{i} / (SELECT sum(a{i}) FROM j{s}) AS w{i}") + f" FROM j{s})"]
    every = range(1, steps + 1)
    out += ["bounds AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {s} AS step, v FROM b{s}" for s in every) + ")",
            f"""done AS MATERIALIZED (SELECT min(a.step) AS s FROM bounds a JOIN bounds z ON a.step = z.step + 1
  WHERE abs(a.v - z.v) <= {tolerance} * abs(z.v))"""]
    return "WITH " + ",\n".join(out) + "\n"


def _settled(steps: int, name: str, columns: str) -> str:
    """Rows of the table ``name`` of the round in which the fit has settled."""
    return " UNION ALL ".join(f"SELECT {columns} FROM {name}{s} WHERE {s} = (SELECT s FROM done)" for s in range(1, steps + 1))


VEM_STEPS = 16
_VEM = vem_sql(VEM_STEPS)
_BETA = (_VEM.rstrip() + ",\nsettled AS MATERIALIZED (" + _settled(VEM_STEPS, "w", "word, w1, w2, w3, w4") + "),\nbeta AS ("
         + " UNION ALL ".join(f"SELECT {i} AS topic, word AS term, w{i} AS beta FROM settled" for i in range(1, 5)) + ")\n")
ORACLE["topic_vem_step"] = vem_sql(1) + " UNION ALL ".join(
    f"SELECT {i} AS topic, word AS term, {r6(f'w{i}', 'beta')} FROM w1" for i in range(1, 5))
ORACLE["topic_vem_bound"] = _VEM + f"""SELECT step, {r6('v / (SELECT sum(n) FROM tc)', 'bound')} FROM bounds
WHERE step <= (SELECT s FROM done)"""
ORACLE["topic_gamma"] = (_VEM.rstrip() + ",\nsettled AS (" + _settled(VEM_STEPS, "g", "author, g1, g2, g3, g4") + ")\n"
                         + " UNION ALL ".join(f"SELECT author, {i} AS topic, {r6(f'g{i} / (g1 + g2 + g3 + g4)', 'gamma')} FROM settled"
                                              for i in range(1, 5)))
ORACLE["topic_beta"] = _BETA + f"SELECT topic, term, {r6('beta')} FROM beta"
ORACLE["topic_top_terms"] = _BETA + f"""SELECT topic, term, {r6('beta')} FROM
  (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS rk FROM beta) WHERE rk <= 5"""
ORACLE["topic_model"] = f"""WITH {TEXT}
SELECT topic, (SELECT count(DISTINCT word) FROM kcounts) AS n_terms, 1.0::DOUBLE AS beta_sum
FROM (VALUES (1), (2), (3), (4)) v(topic)"""

_STATUS = "PARTITION BY o_orderstatus ORDER BY o_orderkey"
ORACLE["panel_lag_halo"] = f"""WITH x AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice AS price,
         first(o_totalprice) OVER ({_STATUS} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS time_price,
         first(o_totalprice) OVER ({_STATUS} RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS time3_price,
         lag(o_totalprice, 2) OVER ({_STATUS}) AS row2_price
  FROM orders)
SELECT o_orderkey, o_orderstatus, {', '.join(r6(c) for c in ('price', 'time_price', 'time3_price', 'row2_price'))},
       {r6('ln(price) - ln(time_price)', 'dlog_price')} FROM x"""
ORACLE["log_rebase_scan"] = f"""SELECT o_orderkey, o_orderstatus, {r6('o_totalprice', 'price')},
  {r6(f'ln(o_totalprice / first_value(o_totalprice) OVER ({_STATUS}))', 'rebased')} FROM orders"""
ORACLE["chain_index_scan"] = f"""WITH daily AS (
  SELECT o_orderpriority AS priority, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS day,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL),
g AS (SELECT *, lag(value) OVER (PARTITION BY priority ORDER BY day) AS lag_value FROM daily),
h AS (SELECT *, (value - lag_value) / lag_value AS growth FROM g)
SELECT priority, day, {r6('value')}, {r6('lag_value')}, {r6('growth')},
       {r6('100 * product(1 + growth) OVER (PARTITION BY priority ORDER BY day)', 'value_index')} FROM h"""


# ------------------------------------------------------------------ crime / police panel

CUTOFF = 1998
REF_YEAR = 1998
FIRST_YEAR = 1995
SEG_INDEX = ("CASE {c} WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
             "WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END")
CRIME_VARS = ["actual_murder", "actual_rape_total", "actual_robbery_total", "actual_assault_total",
              "actual_burg_total", "actual_theft_total", "actual_mtr_veh_theft_total",
              "actual_index_property", "actual_index_violent", "cw_violent", "cw_property", "cw_all",
              "total_employees_officers", "population"]
FINAL_NAMES = {
    "actual_murder": "Y1", "actual_rape_total": "Y2", "actual_robbery_total": "Y3",
    "actual_assault_total": "Y4", "actual_burg_total": "Y5", "actual_theft_total": "Y6",
    "actual_mtr_veh_theft_total": "Y7", "actual_index_violent": "Y8",
    "actual_index_property": "Y9", "cw_violent": "Y10", "cw_property": "Y11", "cw_all": "Y12",
    "total_employees_officers": "S", "population": "C1",
}


def _cnt(cond: str) -> str:
    return f"CAST(count(CASE WHEN {cond} THEN 1 END) AS DOUBLE)"


CRIME = ORD + f""",
cells0 AS (
  SELECT m, c_mktsegment, year,
    {_cnt("o_orderpriority = '1-URGENT'")} AS actual_murder,
    {_cnt("o_orderpriority = '2-HIGH'")} AS actual_rape_total,
    {_cnt("o_orderpriority = '3-MEDIUM'")} AS actual_robbery_total,
    {_cnt("o_orderpriority = '4-NOT SPECIFIED'")} AS actual_assault_total,
    {_cnt("o_orderpriority = '5-LOW'")} AS actual_burg_total,
    {_cnt("o_orderstatus = 'F'")} AS actual_theft_total,
    {_cnt("o_orderstatus = 'P'")} AS actual_mtr_veh_theft_total,
    CAST(sum(price) AS DOUBLE) AS population, count(*) AS n_orders
  FROM ord GROUP BY m, c_mktsegment, year),
cells AS (
  SELECT *, CAST(m AS VARCHAR) || '-' || c_mktsegment AS ORI7, CAST(m AS VARCHAR) AS STATE,
    CAST(100000000 + CAST(m AS BIGINT) * 10 + {SEG_INDEX.format(c='c_mktsegment')} AS BIGINT) AS GOVID,
    0.0::DOUBLE + actual_murder + actual_rape_total + actual_robbery_total + actual_assault_total AS actual_index_violent,
    0.0::DOUBLE + actual_burg_total + actual_theft_total + actual_mtr_veh_theft_total AS actual_index_property
  FROM cells0),
ucr AS (
  SELECT ORI7, STATE, year, actual_murder, actual_rape_total, actual_robbery_total, actual_assault_total,
         actual_burg_total, actual_theft_total, actual_mtr_veh_theft_total, actual_index_property,
         actual_index_violent, population FROM cells),
leoka AS (
  SELECT CAST(o.m AS VARCHAR) || '-' || o.c_mktsegment AS ORI7, CAST(o.m AS VARCHAR) AS STATE, o.year,
         CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_employees_officers
  FROM lineitem l JOIN ord o ON l.l_orderkey = o.o_orderkey GROUP BY o.m, o.c_mktsegment, o.year),
base AS (
  SELECT ORI7, year,
    CASE WHEN year <= {CUTOFF} THEN CAST(n_orders AS DOUBLE) / 1000.0::DOUBLE END AS Z,
    CASE WHEN year <= {CUTOFF} THEN actual_burg_total / 1000.0::DOUBLE END AS C2
  FROM cells WHERE m < 20
  UNION ALL SELECT '99-NONE', 1999, NULL, NULL),
original AS (
  SELECT ORI7, year, CAST(n_orders AS DOUBLE) * 1.5::DOUBLE AS full_time_original FROM cells WHERE year <= {CUTOFF}),
xwalk AS (
  SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS ORI7,
    CAST(100000000 + CAST(c_nationkey AS BIGINT) * 10 + {SEG_INDEX.format(c='c_mktsegment')} AS BIGINT) AS GOVID
  FROM customer),
emp_raw AS (
  SELECT CAST(GOVID * 100000 AS VARCHAR) AS govid, t.type_emp, CAST(n_orders AS DOUBLE) * t.f AS full_time,
    'R' AS full_time_flag, CAST(n_orders AS DOUBLE) * t.f * 1000 AS full_time_payroll, 'R' AS full_time_payroll_flag,
    actual_burg_total AS part_time, 'R' AS part_time_flag, actual_burg_total * 500 AS part_time_payroll,
    'R' AS part_time_payroll_flag, actual_burg_total * 20 AS part_time_hrs, 'R' AS part_time_hrs_flag,
    CAST(n_orders AS DOUBLE) * t.f + actual_burg_total / 2 AS full_time_equivalent, year
  FROM cells, (VALUES (62, 1.0::DOUBLE), (5, 2.0::DOUBLE)) t(type_emp, f) WHERE year > {CUTOFF}),
emp AS (SELECT GOVID, CAST(n_orders AS DOUBLE) AS full_time, year FROM cells WHERE year > {CUTOFF}),
pop_raw AS (
  SELECT CASE WHEN m = 24 AND c_mktsegment = 'MACHINERY' THEN 'UNKNOWN'
         WHEN m = 24 AND c_mktsegment = 'HOUSEHOLD' THEN '1.2.3' ELSE CAST(GOVID * 100000 AS VARCHAR) END AS govid,
    'CITY ' || ORI7 AS name, '1' AS region_code, 'COUNTY ' || STATE AS county_name,
    lpad(CAST(m AS VARCHAR), 2, '0') AS fips_state, lpad(CAST({SEG_INDEX.format(c='c_mktsegment')} AS VARCHAR), 3, '0') AS fips_county,
    CAST(CAST(floor(population / 1000) AS BIGINT) AS VARCHAR) AS pop_asg, substr(CAST(year AS VARCHAR), 3, 2) AS pop_year,
    year, GOVID AS real_govid, m, c_mktsegment
  FROM cells WHERE year > {CUTOFF}),
pop0 AS (
  SELECT CASE WHEN govid IN ('UNKNOWN', '1.2.3') THEN NULL ELSE real_govid END AS GOVID,
         CAST(pop_asg AS DOUBLE) AS pop_asg, year FROM pop_raw),
pop AS (
  SELECT GOVID, pop_asg, year, ln(pop_asg) - ln({lag_t('pop_asg', 'GOVID')}) AS g_pop
  FROM pop0 WHERE GOVID IS NOT NULL),
ucr_all AS (
  SELECT u.*, l.total_employees_officers FROM ucr u
  LEFT JOIN leoka l ON u.ORI7 = l.ORI7 AND u.STATE = l.STATE AND u.year = l.year),
linked AS (
  SELECT s.ORI7, a.STATE, a.year, a.actual_murder, a.actual_rape_total, a.actual_robbery_total,
         a.actual_assault_total, a.actual_burg_total, a.actual_theft_total, a.actual_mtr_veh_theft_total,
         a.actual_index_property, a.actual_index_violent, a.population, a.total_employees_officers,
         o.full_time_original, x.GOVID, e.full_time, p.pop_asg, p.g_pop
  FROM (SELECT DISTINCT ORI7 FROM base) s
  LEFT JOIN ucr_all a ON s.ORI7 = a.ORI7
  LEFT JOIN original o ON s.ORI7 = o.ORI7 AND a.year = o.year
  LEFT JOIN xwalk x ON s.ORI7 = x.ORI7
  LEFT JOIN emp e ON x.GOVID = e.GOVID AND a.year = e.year
  LEFT JOIN pop p ON x.GOVID = p.GOVID AND a.year = p.year),
cw AS (
  SELECT *,
    7000000.0::DOUBLE * actual_murder + 142020.0::DOUBLE * actual_rape_total
      + 12624.0::DOUBLE * actual_robbery_total + 38924.0::DOUBLE * actual_assault_total AS cw_violent,
    2104.0::DOUBLE * actual_burg_total + 473.0::DOUBLE * actual_theft_total
      + 5786.0::DOUBLE * actual_mtr_veh_theft_total AS cw_property
  FROM linked),
cw2 AS (SELECT *, cw_violent + cw_property AS cw_all FROM cw),
prep0 AS (
  SELECT c.*, b.Z AS Z_old, b.C2 FROM cw2 c LEFT JOIN base b ON c.ORI7 = b.ORI7 AND c.year = b.year),
prep AS (
  SELECT * EXCLUDE (Z_old),
    CASE WHEN year > {CUTOFF} THEN ln(full_time) - ln({lag_t('full_time', 'ORI7')}) ELSE Z_old END AS Z,
    dense_rank() OVER (ORDER BY STATE NULLS LAST, year NULLS LAST) AS stateyear,
    dense_rank() OVER (ORDER BY ORI7) AS cityid,
    CASE WHEN STATE IS NOT NULL THEN dense_rank() OVER (ORDER BY STATE NULLS LAST) END AS stateid
  FROM prep0),
g1 AS (
  SELECT ORI7, GOVID, STATE, year, cityid, stateyear,
    {", ".join(f"ln({v}) - ln({lag_t(v, 'ORI7')}) AS {v}" for v in CRIME_VARS)},
    Z, CASE WHEN year > {CUTOFF} THEN g_pop ELSE C2 END AS C2,
    max(CASE WHEN year = {REF_YEAR} THEN population END) OVER (PARTITION BY ORI7) AS W
  FROM prep),
g2 AS (
  SELECT * FROM g1 WHERE year <> {FIRST_YEAR}
    AND ORI7 IS NOT NULL AND GOVID IS NOT NULL AND STATE IS NOT NULL AND cityid IS NOT NULL AND stateyear IS NOT NULL
    AND {" AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in CRIME_VARS + ["Z", "C2", "W"])}),
crime_final AS (
  SELECT ORI7, GOVID, STATE, year, cityid, stateyear,
    {", ".join(f"CASE WHEN isinf({v}) THEN 0.0 ELSE {v} END AS {FINAL_NAMES.get(v, v)}" for v in CRIME_VARS + ["Z", "C2", "W"])}
  FROM g2)"""


def _sel(cols, src):
    return "SELECT " + ", ".join(cols) + f" FROM {src}"


_UCR_D = ["actual_murder", "actual_rape_total", "actual_robbery_total", "actual_assault_total",
          "actual_burg_total", "actual_theft_total", "actual_mtr_veh_theft_total",
          "actual_index_property", "actual_index_violent", "population"]

ORACLE["scan_csv_multi"] = f"WITH {CRIME} SELECT * FROM emp_raw"
ORACLE["scan_fixed_width"] = (f"WITH {CRIME} SELECT govid, name, region_code, county_name, fips_state, fips_county, "
                              "pop_asg, pop_year, year FROM pop_raw")
ORACLE["ingest_year_from_file"] = f"WITH {CRIME} SELECT year, count(*) AS n_rows, {r6('sum(full_time)', 'full_time')} FROM emp_raw GROUP BY year"
ORACLE["asg_employment"] = f"WITH {CRIME} SELECT GOVID, {r6('full_time')}, year FROM emp"
ORACLE["asg_population"] = f"WITH {CRIME} SELECT GOVID, {r6('pop_asg')}, year, {r6('g_pop')} FROM pop"
ORACLE["id_scale"] = f"WITH {CRIME} SELECT govid, year, CASE WHEN govid IN ('UNKNOWN', '1.2.3') THEN NULL ELSE real_govid END AS scaled_id FROM pop_raw"
ORACLE["crime_panel_linked"] = (f"WITH {CRIME} SELECT ORI7, STATE, year, GOVID, "
                                + ", ".join(r6(c) for c in _UCR_D + ["total_employees_officers", "full_time_original", "full_time", "pop_asg", "g_pop"])
                                + " FROM linked")
ORACLE["cost_weighted_sum"] = f"""WITH {CRIME}, c AS (
  SELECT ORI7, year,
    7000000.0::DOUBLE * actual_murder + 142020.0::DOUBLE * actual_rape_total
      + 12624.0::DOUBLE * actual_robbery_total + 38924.0::DOUBLE * actual_assault_total AS cw_violent,
    2104.0::DOUBLE * actual_burg_total + 473.0::DOUBLE * actual_theft_total
      + 5786.0::DOUBLE * actual_mtr_veh_theft_total AS cw_property FROM ucr)
SELECT ORI7, year, {r6('cw_violent')}, {r6('cw_property')}, {r6('cw_violent + cw_property', 'cw_all')} FROM c"""
ORACLE["series_splice"] = f"WITH {CRIME} SELECT ORI7, year, {r6('Z')} FROM prep"
ORACLE["group_id"] = f"WITH {CRIME} SELECT ORI7, year, STATE, stateyear FROM prep"
ORACLE["unit_id"] = f"WITH {CRIME} SELECT ORI7, year, STATE, cityid, stateid FROM prep"
ORACLE["base_period_weight"] = (f"WITH {CRIME} SELECT ORI7, year, "
                                f"{r6(f'max(CASE WHEN year = {REF_YEAR} THEN population END) OVER (PARTITION BY ORI7)', 'W')} FROM linked")
ORACLE["crime_panel_final"] = (f"WITH {CRIME} SELECT ORI7, GOVID, STATE, year, cityid, stateyear, "
                               + ", ".join(r6(FINAL_NAMES.get(v, v)) for v in CRIME_VARS + ["Z", "C2", "W"])
                               + " FROM crime_final")
ORACLE["sample_restrict"] = (f"WITH {CRIME} SELECT s.ORI7, a.STATE, a.year, "
                             + ", ".join(r6(f"a.{c}", c) for c in _UCR_D + ["total_employees_officers"])
                             + " FROM (SELECT DISTINCT ORI7 FROM base) s LEFT JOIN ucr_all a ON s.ORI7 = a.ORI7")
ORACLE["distinct_keys"] = f"WITH {CRIME} SELECT DISTINCT ORI7 FROM base"
ORACLE["crosswalk_bridge"] = f"""WITH {CRIME}
SELECT u.ORI7, u.year, x.GOVID, {r6('e.full_time', 'full_time')}
FROM ucr u LEFT JOIN xwalk x ON u.ORI7 = x.ORI7 LEFT JOIN emp e ON x.GOVID = e.GOVID AND u.year = e.year"""
ORACLE["join_left_3key"] = (f"WITH {CRIME} SELECT u.ORI7, u.STATE, u.year, "
                            + ", ".join(r6(f"u.{c}", c) for c in _UCR_D)
                            + f", {r6('l.total_employees_officers', 'total_employees_officers')}"
                            + f""" FROM ucr u LEFT JOIN (SELECT * FROM leoka WHERE year <= {CUTOFF}) l
  ON u.ORI7 = l.ORI7 AND u.STATE = l.STATE AND u.year = l.year""")
ORACLE["join_left_2key"] = f"""WITH {CRIME}
SELECT u.ORI7, u.year, {r6('u.population', 'population')}, {r6('b.Z', 'Z')}, {r6('b.C2', 'C2')}
FROM ucr u LEFT JOIN base b ON u.ORI7 = b.ORI7 AND u.year = b.year"""
ORACLE["join_left"] = f"WITH {CRIME} SELECT u.ORI7, u.year, x.GOVID FROM ucr u LEFT JOIN (SELECT * FROM xwalk WHERE ORI7 IN (SELECT ORI7 FROM base)) x ON u.ORI7 = x.ORI7"
ORACLE["join_right"] = f"""WITH {CRIME}
SELECT u.ORI7, u.year, {r6('b.Z', 'Z')}, {r6('b.C2', 'C2')}, {r6('u.population', 'population')}
FROM base b RIGHT JOIN ucr u ON b.ORI7 = u.ORI7 AND b.year = u.year"""
ORACLE["join_suffix"] = f"""WITH {CRIME}
SELECT u.ORI7, u.year, u.STATE AS STATE_x, {r6('u.population', 'population')}, l.STATE AS STATE_y,
       {r6('l.total_employees_officers', 'total_employees_officers')}
FROM ucr u LEFT JOIN leoka l ON u.ORI7 = l.ORI7 AND u.year = l.year"""
ORACLE["join_nullsafe"] = f"""WITH {CRIME}, ids AS (
  SELECT CASE WHEN govid IN ('UNKNOWN', '1.2.3') THEN NULL ELSE real_govid END AS GOVID, year, pop_asg FROM pop_raw),
per_key AS (SELECT GOVID, year, count(*) AS n_rows FROM ids GROUP BY GOVID, year)
SELECT a.GOVID, a.year, a.pop_asg AS pop_x, k.n_rows
FROM ids a LEFT JOIN per_key k ON a.GOVID IS NOT DISTINCT FROM k.GOVID AND a.year = k.year"""


# ------------------------------------------------------------------ sparse customer grid

GRID = """
cg AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS DOUBLE) AS n_urgent,
    CAST(count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS DOUBLE) AS n_low,
    count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
  FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS INTEGER))"""


def _cl(x):
    return lag_t(x, "o_custkey")


def _dl(x):
    return f"ln({x}) - ln({_cl(x)})"


GRID_DLOG = GRID + f""",
dm AS (
  SELECT o_custkey, year, {_dl('n_urgent')} AS n_urgent, {_dl('n_low')} AS n_low,
         {_dl('n_orders')} AS n_orders, {_dl('revenue')} AS revenue FROM cg),
cc AS (SELECT * FROM dm WHERE {" AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in ["n_urgent", "n_low", "n_orders", "revenue"])})"""
_GV = ["n_urgent", "n_low", "n_orders", "revenue"]

ORACLE["panel_validate"] = f"""WITH {GRID}
SELECT o_custkey, count(*) AS n_periods, min(year) AS first_period, max(year) AS last_period,
  CAST((max(year) - min(year)) / 1 + 1 - count(*) AS BIGINT) AS n_gaps,
  CAST(sum(r) - count(*) AS BIGINT) AS n_duplicates
FROM (SELECT o_custkey, year, count(*) AS r FROM cg GROUP BY o_custkey, year) GROUP BY o_custkey"""
ORACLE["panel_lag_time"] = f"WITH {GRID} SELECT o_custkey, year, {r6('revenue')}, {r6(_cl('revenue'), 'lag_revenue')} FROM cg"
ORACLE["panel_lag_row"] = (f"WITH {GRID} SELECT o_custkey, year, {r6('revenue')}, "
                           f"{r6('lag(revenue) OVER (PARTITION BY o_custkey ORDER BY year)', 'lag_revenue')} FROM cg")
_GR = {v: f"({v} - {_cl(v)}) / {_cl(v)}" for v in ("revenue", "n_urgent")}
ORACLE["panel_growth"] = (f"WITH {GRID} SELECT o_custkey, year, {r6(_GR['revenue'], 'g_revenue')}, "
                          f"{r6(_GR['n_urgent'], 'g_urgent')} FROM cg")
ORACLE["panel_dlog"] = f"WITH {GRID} SELECT o_custkey, year, {r6(_dl('n_urgent'), 'dlog_urgent')} FROM cg"
ORACLE["panel_dlog_many"] = f"WITH {GRID_DLOG} SELECT o_custkey, year, {', '.join(r6(v) for v in _GV)} FROM dm"
ORACLE["panel_drop_first"] = f"WITH {GRID_DLOG} SELECT o_custkey, year, {', '.join(r6(v) for v in _GV)} FROM dm WHERE year <> 1995"
ORACLE["complete_cases"] = f"WITH {GRID_DLOG} SELECT o_custkey, year, {', '.join(r6(v) for v in _GV)} FROM cc"
ORACLE["inf_to_zero"] = (f"WITH {GRID_DLOG} SELECT o_custkey, year, "
                         + ", ".join(r6(f"CASE WHEN isinf({v}) THEN 0.0 ELSE {v} END", v) for v in _GV) + " FROM cc")
ORACLE["lagged_share"] = f"""WITH {GRID}, s AS (
  SELECT o_custkey, year, {_cl('n_urgent')} / ({_cl('n_urgent')} + {_cl('n_low')}) AS s_urgent FROM cg)
SELECT o_custkey, year, {r6('s_urgent')}, {r6('1.0 - s_urgent', 's_low')} FROM s"""
ORACLE["index_to_base"] = f"""WITH {GRID}, b AS (
  SELECT *, max(CASE WHEN year = 1995 THEN revenue END) OVER (PARTITION BY o_custkey) AS base_revenue,
         max(CASE WHEN year = 1995 THEN 1 END) OVER (PARTITION BY o_custkey) AS has_base FROM cg)
SELECT o_custkey, year, {r6('revenue')}, {r6('base_revenue')}, {r6('100.0 * revenue / base_revenue', 'revenue_index')}
FROM b WHERE has_base = 1"""
ORACLE["log_rebase"] = (f"WITH {GRID} SELECT o_custkey, year, "
                        f"{r6('ln(revenue / first_value(revenue) OVER (PARTITION BY o_custkey ORDER BY year))', 'rebased')} FROM cg")

# ------------------------------------------------------------------ trade panel extras

_W = "WITH " + TRADE_WORLD
ORACLE["absorption_growth"] = ("WITH " + TRADE_PANEL + " SELECT year, country, "
                               + ", ".join(r6(c) for c in ["C", "I", "s_C", "s_I", "DA_growth"]) + " FROM panel")
ORACLE["trade_weight"] = "WITH " + TRADE_PANEL + f" SELECT year, country, {r6('w')} FROM panel"
ORACLE["weighted_sum_by_time"] = "WITH " + TRADE_PANEL + f" SELECT year, {r6('FA_components')} FROM fa0"
ORACLE["chain_index"] = ("WITH " + TRADE_PANEL + f""" SELECT y.year,
  {r6(f'CASE WHEN y.year = {BASE_YEAR} THEN 100.0 ELSE fa.FA END', 'FA')}
FROM (SELECT DISTINCT year FROM world) y LEFT JOIN fa ON y.year = fa.year""")
ORACLE["join_inner_base"] = _W + f""", wl AS (SELECT *, cons_final + gfcf_final AS DA_level FROM world)
SELECT a.year, a.country, {r6('a.DA_level', 'DA_level')}, {r6('b.DA_level', 'baseDA')}
FROM wl a JOIN (SELECT country, DA_level FROM wl WHERE year = {BASE_YEAR}) b ON a.country = b.country"""
ORACLE["broadcast_reporter"] = _W + f" SELECT year, country, {r6('total_exports')} FROM world"
ORACLE["key_override"] = _W + f""" SELECT year, country,
  CASE WHEN country = '{REPORTER}' THEN 'REP' ELSE partner_iso END AS code FROM world"""
ORACLE["proj_select"] = f"SELECT o_orderkey, o_orderdate, {r6('o_totalprice')} FROM orders"
ORACLE["proj_drop"] = _W + " SELECT year, country, " + ", ".join(r6(c) for c in [
    "cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal", "nom_exports_dom",
    "nom_imports_dom", "real_exports", "real_imports"]) + " FROM world"
ORACLE["proj_reorder"] = _W + f" SELECT {r6('total_exports')}, year, country, {r6('real_exports')}, {r6('real_imports')} FROM world"
ORACLE["proj_rename"] = _W + f" SELECT year, country, {r6('cons_final', 'consumption')}, {r6('gfcf_final', 'investment')} FROM world"
ORACLE["proj_derive"] = _W + f""" SELECT year, country, {r6('cons_final + gfcf_final', 'DA_level')},
  {r6('nom_exports_dom / nom_imports_dom', 'TR')}, {r6('-real_imports', 'neg_imports')} FROM world"""
ORACLE["filter_eq"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'"
ORACLE["filter_ne"] = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"
ORACLE["filter_not_null"] = _W + f" SELECT year, country, {r6('exports_by_reporter')} FROM world WHERE exports_by_reporter IS NOT NULL"
ORACLE["ifelse_na"] = _W + """ SELECT year, country,
  CASE WHEN exports_by_reporter IS NULL THEN NULL WHEN exports_by_reporter > 1000000.0 THEN 'large' ELSE 'small' END AS size FROM world"""
ORACLE["sort_multi"] = _W + f""" SELECT country, year, {r6('cons_final')},
  row_number() OVER (ORDER BY country, year) AS position FROM world ORDER BY country, year"""
ORACLE["union_by_name"] = _W + f" SELECT year, country, {r6('cons_final')} FROM world"
ORACLE["unpivot_components"] = _W + " SELECT year, country, name, " + r6("value") + " FROM (" + " UNION ALL ".join(
    f"SELECT year, country, '{c}' AS name, {c} AS value FROM world" for c in
    ["cons_final", "gfcf_final", "cons_final_nominal", "gfcf_final_nominal"]) + ")"
def significant(table: str, c: str, digits: int = 2) -> str:
    """Decimals of a column so that every entry shows ``digits`` significant digits, as a common
    format does: of each entry's digits in scientific notation, zeros at the end do not count."""
    sci = f"format('{{:.{digits - 1}e}}', abs({c}))"
    exponent = f"CAST(split_part({sci}, 'e', 2) AS INTEGER)"
    mantissa = f"rtrim(replace(split_part({sci}, 'e', 1), '.', ''), '0')"
    return (f"(SELECT max(greatest(0, length({mantissa}) - 1 - {exponent})) FROM {table} "
            f"WHERE {c} <> 0 AND isfinite({c}))")


ORACLE["format_numeric_cols"] = "WITH " + TRADE_REPORTER + """,
periods AS (SELECT * FROM (VALUES (1995, 1997), (1998, 2000)) v(start_y, end_y)),
pt AS (
  SELECT CAST(p.start_y AS VARCHAR) || '-' || CAST(p.end_y AS VARCHAR) AS period,
    (e.log_R - s.log_R) * 100 AS R, (e.log_TR - s.log_TR) * 100 AS TR, (e.log_FA - s.log_FA) * 100 AS FA,
    -((e.log_DA - s.log_DA) * 100) AS DA, (e.log_FMI - s.log_FMI) * 100 AS FMI, -((e.log_DMI - s.log_DMI) * 100) AS DMI
  FROM periods p LEFT JOIN reporter s ON s.year = p.start_y LEFT JOIN reporter e ON e.year = p.end_y)
SELECT period, """ + ", ".join(f"format('{{:.' || {significant('pt', c)} || 'f}}', {c}) AS {c}" for c in ["R", "TR", "FA", "DA", "FMI", "DMI"]) + " FROM pt"

# ------------------------------------------------------------------ scalar functions

ORACLE["scalar_string"] = """SELECT c_custkey, upper(lower(c_mktsegment)) AS segment,
  CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS label FROM customer"""
ORACLE["scalar_math"] = f"""SELECT l_orderkey, l_linenumber, {r6('ln(l_quantity)', 'ln_qty')},
  {r6('l_extendedprice * (1 - l_discount)', 'net')}, {r6('-l_tax', 'neg_tax')},
  {r6('l_extendedprice / l_quantity', 'unit_price')}, {r6('l_discount / l_tax', 'disc_per_tax')} FROM lineitem"""
ORACLE["scalar_try_cast"] = """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio_num,
  TRY_CAST(o_orderpriority AS DOUBLE) AS prio_bad,
  TRY_CAST(' ' || CAST(o_orderkey AS VARCHAR) || ' ' AS DOUBLE) AS padded FROM orders"""
ORACLE["ordered_levels"] = """SELECT doc_id, lang,
  CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 END AS lang_level FROM documents"""

# ------------------------------------------------------------------ scans, sinks, nested series

ORACLE["scan_table"] = f"SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} FROM orders"
ORACLE["scan_csv_header"] = "SELECT c_custkey, c_name, upper(lower(c_mktsegment)) AS partner_iso FROM customer"
ORACLE["scan_csv_inferred"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS DOUBLE)
            ELSE round(CAST(o_totalprice AS DOUBLE), 2) END AS price,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 END AS large,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus,
       'day date, large boolean, o_orderkey bigint, o_orderstatus string, price double' AS types
FROM orders WHERE o_orderstatus IS NOT NULL"""
ORACLE["sink_csv_roundtrip"] = ORACLE["trade_decomposition"]
ORACLE["sink_parquet_roundtrip"] = ORACLE["crime_panel_final"]
ORACLE["sink_dta_roundtrip"] = ORACLE["crime_panel_final"]
ORACLE["scan_dta"] = f"""
SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation, coalesce(c_mktsegment, '') AS c_mktsegment,
       CASE WHEN why IS NULL THEN {R6.format(x='CAST(c_acctbal AS DOUBLE)')} END AS balance,
       CASE WHEN why IS NOT NULL THEN why WHEN c_acctbal IS NULL THEN '.' END AS balance_missing
FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN '.a' WHEN c_mktsegment = 'MACHINERY' THEN '.b' END AS why FROM customer)
LEFT JOIN nation ON n_nationkey = c_nationkey"""
LEVEL = """CASE {p} WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3
  WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 END"""
ORACLE["factor_union"] = f"""
WITH o AS (SELECT o_orderstatus = 'F' AS done, o_orderpriority AS p, {LEVEL.format(p='o_orderpriority')} AS l
           FROM orders WHERE o_orderstatus IS NOT NULL),
k AS (SELECT done, CASE WHEN done AND l <= 3 OR NOT done AND l >= 3 THEN p END AS priority,
             CASE WHEN done AND l <= 3 OR NOT done AND l >= 3 THEN l END AS level FROM o)
SELECT done, priority, level, count(*) AS n FROM k GROUP BY ALL"""
ORACLE["factor_sort"] = f"""
WITH o AS (SELECT o_custkey, {LEVEL.format(p='o_orderpriority')} AS l, o_orderpriority AS p FROM orders)
SELECT o_custkey, max_by(p, l) AS priority, max(l) AS level, count(*) AS n FROM o GROUP BY o_custkey"""
ORACLE["stage_resume"] = """
SELECT c_nationkey AS nation, year(o_orderdate) AS year, count(*) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
NESTED = """
daily AS (
  SELECT event_type AS freq, user_id AS ref_area, CAST(ts AS DATE) AS day,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM events GROUP BY event_type, user_id, CAST(ts AS DATE))"""
ORACLE["nested_series_scan"] = f"WITH {NESTED} SELECT freq, ref_area, CAST(count(*) FILTER (day BETWEEN '2024-01-05' AND '2024-01-20') AS INTEGER) AS n_obs FROM daily WHERE freq = 'click' AND ref_area < 100 GROUP BY freq, ref_area"
ORACLE["unnest_obs"] = f"WITH {NESTED} SELECT freq, ref_area, day, {r6('value')} FROM daily"
