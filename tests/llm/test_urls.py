import re

import duckdb

from rivulet.llm import oracles, urls
from rivulet.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def brute(url):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = match.groups() if match else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(
        ((len(h + p), verdict, h + p) for verdict, h, p in urls.HOST_RULES
         if (host == h or host.endswith("." + h)) and path.startswith(p)),
        default=None,
    )
    if best:
        return host, path, best[2], best[1]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    hit = {k for k, p in urls.PATTERNS if url is not None and re.search(oracles._regex(p), low)}
    return host, path, None, "block" if hit == {"block"} else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://org/",
    "http://org", "http://badexample.org/es/1", "http://a.com/fr/", "http://a.com/de/x", "http://a.com/de",
    "https://spam-farm.example.net/en/1", "https://www.Spam-Farm.example.com/en", "https://notspam-farm.net/",
    "https://cheap-pills.example.com/buy", "https://x.cheap-pills.example.com/about", "https://casino-1.net/",
    "https://ads.example.net/a/click?x", "https://example.net/wp-login.php", "https://example.net/wp-login.phpx",
    "https://e.net/?a=1&sessionid=3", "a://b://c.com/fr/d", "http://ÉX.com/fr/é", "http://h.net:80/p?q=://org/",
    "http://" + "a." * 3000 + "com/fr/x", "x" * 100_000, "http://h\n.com/fr/\n",
]


def test_matches_plain_python(spark):
    rows = [(k, u, "") for k, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, PAGES)
    got = urls.judged(pages, urls.host_rules(spark), urls.patterns(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(rows[r.page_id][1]), rows[r.page_id][1]


def test_index_takes_the_rarest_word(spark):
    rows = [(k, f"http://common.net/{'rare' if k == 0 else 'often'}/x", "") for k in range(5)]
    low = spark.createDataFrame(rows, PAGES).selectExpr("url", "url AS low")
    rules = spark.createDataFrame(
        [(1, "block", "/often/x|"), (2, "block", "||common.net/rare/"), (3, "block", "ofte"), (4, "block", "/never/"),
         (5, "block", "/rare*/")],
        "rule_id long, verdict string, pattern string",
    )
    got = {r.rule_id: r.word for r in urls.indexed(rules, low).collect()}
    assert got == {1: "often", 2: "rare", 3: "", 4: "never", 5: ""}
    hit = {r.url: r.pattern_id for r in urls.pattern_verdicts(low, rules).collect()}
    assert hit == {u: 2 if "rare" in u else 1 for _, u, _ in rows}


def test_no_rows_no_rules_and_clashing_columns(spark):
    pages = spark.createDataFrame([(None, "http://a.com/de/", ""), (1, None, None)], PAGES).selectExpr(
        "*", "1 AS host", "2 AS path", "3 AS rule", "4 AS word"
    )
    rules, patterns = urls.host_rules(spark), urls.patterns(spark)
    assert urls.judged(pages.where("false"), rules, patterns).count() == 0
    assert {r.verdict for r in urls.judged(pages, rules.where("false"), patterns.where("false")).collect()} == {"allow"}
    assert {(r.page_id, r.verdict) for r in urls.judged(pages, rules, patterns).collect()} == {(None, "block"), (1, "allow")}


def test_main_path_is_native(spark, sf_dir, capsys):
    for name in ("op5_line_dedup", "op7_url_verdicts", "op10_hash_tree_shards"):
        QUERIES[name](spark, sf_dir).explain()
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    want = sorted(map(repr, db.execute(oracles.ORACLES["op7_url_verdicts"]).fetchall()))
    got = QUERIES["op7_url_verdicts"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
