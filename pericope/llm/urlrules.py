"""URL filtering by pattern rules, indexed by each rule's rarest literal token.

A rule is a regular expression that is searched for in the lower-cased URL. Its
literals are words that any URL it matches must contain as whole tokens; where a
match contains one of several, they are one literal, joined by |, and NUMBER
stands for any token of digits. The literal that is rarest over all URLs becomes
the rule's key. A URL's tokens fetch the rules under them, and only those run.

A rule without literals is fetched by every URL: it is under EVERY, a token that
all URLs have as soon as there is such a rule. The index is no larger than the
rules. It goes to every executor where their number, which is counted, is at most
MOST_RULES; beyond that it is joined by shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.llm.shared import only

NUMBER, EVERY = "#", "*"
MOST_RULES = 100_000

#: (rule_id, action, pattern, literals). Actions: block drops a URL, allow overrides block.
RULES: list[tuple[int, str, str, list[str]]] = [
    (1, "block", r"^https?://([a-z0-9-]+\.)*cheap-pills\.", ["cheap", "pills"]),
    (2, "block", r"^https?://([a-z0-9-]+\.)*spam-farm\.", ["spam", "farm"]),
    (3, "block", r"://[^/]*\bcasino\b", ["casino"]),
    (4, "block", r"://[^/]*\bfree-movies\b", ["free", "movies"]),
    (5, "block", r"[?&]ref=x(&|$)", ["ref", "x"]),
    (6, "tag", r"[?&]utm_source=feed(&|#|$)", ["utm", "source", "feed"]),
    (7, "tag", r"[?&]page=[0-9]+(&|#|$)", ["page", "#"]),
    (8, "tag", r"\.html?([?#]|$)", ["htm|html"]),
    (9, "tag", r"^http://", ["http"]),
    (10, "block", r"/(login|signup|cart)(/|[?#]|$)", ["login|signup|cart"]),
    (11, "block", r"/wp-admin/", ["wp", "admin"]),
    (12, "tag", r"^https?://m\.", ["m"]),
    (13, "tag", r"^https?://blog\.", ["blog"]),
    (14, "block", r"\bsessionid=[0-9a-f]{16,}", ["sessionid"]),
    (15, "block", r"^https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[:/]", ["#"]),
    (16, "allow", r"^https?://([a-z0-9-]+\.)*example\.org/[a-z]{2}/[0-9]+\.html$", ["example", "org", "html"]),
    (17, "block", r"://[^/]*\badult\b", ["adult"]),
    (18, "block", r"\.(exe|zip|dmg|apk)([?#]|$)", ["exe|zip|dmg|apk"]),
    (19, "tag", r"#top$", ["top"]),
    (20, "block", r"/tag/[^/]+/page/[0-9]+", ["tag", "page"]),
    (21, "block", r"://[^/]*\bdoubleclick\b", ["doubleclick"]),
    (22, "tag", r"/[0-9]+/$", ["#"]),
]
SCHEMA = "rule_id int, action string, pattern string, literals array<string>"


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, SCHEMA)


def match_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per URL row and matching rule: (page_id, rule_id, action).

    Distinct (page_id, url) rows are matched once, so repeated rows give each
    match once. A null or empty URL matches nothing, unless a pattern matches
    the empty text and has no literals. URLs of any length are read whole. URLs
    with a null page_id are matched and keep the null. A null pattern never
    matches; null or missing literals mean none. A literal has to be right: a
    rule isn't run on a URL without it. Ties in rarity go to the literal that
    sorts first. Either table may be empty. Other columns are ignored, whatever
    their names. Ids have to be of whole numbers, else a TypeError.
    """
    u = only(urls, page_id=id_col, url=url_col).select("page_id", F.lower(F.coalesce("url", F.lit(""))).alias("u")).distinct()
    r = only(rules, id="rule_id", action="action", pattern="pattern", literals="literals").withColumnRenamed("id", "rule_id").where("pattern is not null")
    few = r.count() <= MOST_RULES
    near = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    lit = r.select("rule_id", "action", "pattern", F.explode_outer(F.transform("literals", lambda x: F.lower(x))).alias("literal")).distinct()
    lit = lit.withColumn("token", F.explode(F.split(F.coalesce("literal", F.lit(EVERY)), r"\|")))
    wanted = lit.select("token").distinct()
    distinct = u.select("u").distinct()
    found = F.col("found")
    number = F.when(F.exists(found, lambda x: x.rlike("^[0-9]+$")), F.array(F.lit(NUMBER))).otherwise(F.array().cast("array<string>"))
    # only tokens that some rule names go on
    split = distinct.select("u", F.regexp_extract_all("u", F.lit("([a-z0-9]+)"), F.lit(1)).alias("found"))
    tokens = split.select("u", F.explode(F.array_distinct(F.concat(found, number, F.array(F.lit(EVERY))))).alias("token")).join(near(wanted), "token", "left_semi")
    seen = tokens.groupBy("token").count()
    # how many URLs a literal fetches; of several rules' worth of work, the least
    cost = lit.join(seen, "token", "left").groupBy("rule_id", "action", "pattern", "literal").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    key = W.partitionBy("rule_id", "pattern").orderBy(F.expr("literal is null"), "n", "literal")
    best = cost.withColumn("at", F.row_number().over(key)).where("at = 1").select("rule_id", "action", "pattern", "literal")
    index = best.withColumn("token", F.explode(F.split(F.coalesce("literal", F.lit(EVERY)), r"\|"))).select("token", "rule_id", "action", "pattern")
    hit = tokens.join(near(index), "token").where(F.expr("u rlike pattern")).select("u", "rule_id", "action").distinct()
    return u.join(hit, "u").select("page_id", "rule_id", "action").distinct()


def verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """match_rules() by page: (page_id, n_rules, rules, blocked), for every page, rules as sorted text; blocked if a block rule matches and no allow rule does.

    Nulls, empty and long URLs, repeated rows, ties, empty tables and other
    columns are treated as in match_rules(); a page without a match has 0 rules,
    an empty text and isn't blocked. The rows of one page_id count together.
    """
    m = match_rules(urls, rules, id_col, url_col)
    by = m.groupBy("page_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("ids"),
        F.max(F.expr("int(action = 'block')")).alias("block"),
        F.max(F.expr("int(action = 'allow')")).alias("allow"),
    )
    pages = only(urls, page_id=id_col).distinct()
    out = pages.alias("p").join(by.alias("m"), F.expr("p.page_id <=> m.page_id"), "left")
    return out.select(
        "p.page_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_rules"),
        F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("rules"),
        F.coalesce(F.expr("block = 1 and allow = 0"), F.lit(False)).alias("blocked"),
    )


def sql(table: str = "pages") -> str:
    """Every rule on every URL, without the index."""
    values = ", ".join("({}, '{}', '{}')".format(i, a, p.replace("'", "''")) for i, a, p, _ in RULES)
    return f"""
WITH r(rule_id, action, pattern) AS (VALUES {values}),
m AS (SELECT DISTINCT page_id, rule_id, action FROM {table}, r WHERE regexp_matches(lower(coalesce(url, '')), pattern))
SELECT p.page_id, count(rule_id) AS n_rules, coalesce(string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id), '') AS rules,
  coalesce(bool_or(action = 'block'), false) AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
FROM (SELECT DISTINCT page_id FROM {table}) p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id GROUP BY p.page_id"""
