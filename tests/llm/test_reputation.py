"""Verdicts of the method itself: SQL and Spark on hosts on both sides of the bound, and a bound told by hand."""

import duckdb
import numpy as np

from lectern.llm import hostrep, queries


def test_sql_agrees_where_the_method_decides(spark, tmp_path):
    rng = np.random.default_rng(4)
    names = [f"{sub}.{site}.{suffix}" for suffix in ("co.uk", "org", "com.au", "net") for site in ("alpha", "beta", "gamma") for sub in ("www", "blog", "m", "x.y")] + ["co.uk", "localhost", ""]
    bad = dict(zip(names, rng.beta(0.6, 1.2, len(names)), strict=True))
    pages, labels, n = [], [], 0
    for host in names:
        for _ in range(int(rng.integers(1, 60))):
            n += 1
            pages.append((n, f"https://{host}/q/{n}" if host else None))
            labels.append((n, int(rng.random() > bad[host]), int(rng.random() < 0.05)))
    pages += pages[:40]  # rows that repeat
    labels += [(5, 0, 0), (6, None, 1), (None, 1, 1)]
    spark.createDataFrame(pages, "page_id long, url string").toPandas().to_parquet(tmp_path / "pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}).to_parquet(tmp_path / "labels.parquet")
    got = sorted(map(tuple, queries.op7_host_reputation(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({hostrep.ORACLE})").fetchall(), key=repr)
    assert got == want
    free = [v for _, h, _, rule, v in got if rule is None and h]
    assert 0.1 < free.count("block") / len(free) < 0.9
    by_host = {h: v for _, h, _, rule, v in got if rule is None}
    assert len({v for h, v in by_host.items() if h.endswith("co.uk")}) == 2


def test_bounds_against_the_definition(spark):
    seen = [("a.x.org", 1)] * 9 + [("a.x.org", 0)] + [("b.x.org", 0)] * 10 + [("c.y.org", 1)] * 2 + [("d.z.net", 0)] * 8
    rows = hostrep.reputations(spark.createDataFrame(seen, "host string, bad int"), z=1.0).collect()
    hosts = {"a.x.org": (9, 10), "b.x.org": (0, 10), "c.y.org": (2, 2), "d.z.net": (0, 8)}

    def prior(groups):
        n, x = np.array([g[1] for g in groups], float), np.array([g[0] for g in groups], float)
        p, mean = x / n, x.sum() / n.sum()
        between = (n * (p - mean) ** 2).sum() / (len(n) - 1)
        within = (n * p * (1 - p)).sum() / (n.sum() - len(n))
        size = (n.sum() - (n**2).sum() / n.sum()) / (len(n) - 1)
        rho = (between - within) / (between + (size - 1) * within)
        return min(1000, max(2, 1 / rho - 1)) if rho > 0 else 1000

    kh, kd, ks = prior(list(hosts.values())), prior([(9, 20), (2, 2), (0, 8)]), prior([(11, 22), (0, 8)])
    suffix = {"org": (11 + ks * 12 / 32) / (22 + ks), "net": (0 + ks * 12 / 32) / (8 + ks)}
    domain = {"x.org": (9 + kd * suffix["org"]) / (20 + kd), "y.org": (2 + kd * suffix["org"]) / (2 + kd), "z.net": (0 + kd * suffix["net"]) / (8 + kd)}
    for r in rows:
        x, n = hosts[r["host"]]
        m = domain[r["host"].split(".", 1)[1]]
        a, b = x + kh * m, n - x + kh * (1 - m)
        assert abs(r["bound"] - (a / (a + b) - np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))) < 1e-9
    assert len(rows) == 4
