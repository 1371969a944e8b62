from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.functions import vectors as V


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_code_tokens(spark):
    cases = {
        "handleUserAuth": ["handle", "user", "auth", "handleuserauth"],
        "getHTTPResponse": ["get", "http", "response", "gethttpresponse"],
        "MAX_CHUNK_CHARS": ["max", "chunk", "chars"],
        "kebab-case dot.notation": ["kebab", "case", "dot", "notation"],
        "v2Config": ["config", "v2config"],
        "a b c": [],
        "": [],
        "naïve": ["na", "ve"],
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want array<string>").select("want", T.code_tokens(F.col("t")).alias("got"))
    for r in df.collect():
        assert sorted(r["got"]) == sorted(r["want"])


def brute_chunks(text, most=1600, least=200):
    import re

    out = []
    for p in [x.strip() for x in re.split(r"\n\n+", text) if x.strip()]:
        if len(p) <= most:
            out.append(p)
            continue
        cur = ""
        for s in [x for x in re.split(r"(?<=\.)\s+", p) if x]:
            if len(s) > most:
                out += [cur] if cur else []
                cur = ""
                out += [s[i : i + most] for i in range(0, len(s), most)]
            elif cur and len(cur) + 1 + len(s) > most:
                out.append(cur)
                cur = s
            else:
                cur = f"{cur} {s}" if cur else s
        out += [cur] if cur else []
    raw, cur = [], ""
    for p in out:
        if cur and len(cur) + 2 + len(p) > most:
            raw.append(cur)
            cur = p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    raw += [cur] if cur else []
    return raw if len(raw) == 1 else [c for c in raw if len(c) >= least]


def test_paragraph_chunks(spark):
    texts = ["", "  \n\n ", "short", "a" * 4000, ("word. " * 700).strip(), "x. " * 300 + "\n\n" + "y" * 1700 + ". z", "\n\n".join("p%d " % i * 60 for i in range(40)), "a\n\n\n\nb\nc", "q" * 1601]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.paragraph_chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert r["c"] == brute_chunks(r["t"])


def test_token_windows(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 500, 501, 950, 951, 1400, 1401)], "n int").select("n", T.token_windows(F.col("n")).alias("w"))
    for r in df.collect():
        want, start = [], 0
        while True:
            end = min(start + 500, r["n"])
            want.append((start, end))
            if end == r["n"]:
                break
            start += 450
        assert [tuple(x) for x in r["w"]] == want


def test_ids_and_formats(spark):
    assert one(spark, T.chunk_id(F.col("p"), F.col("i")), p="src/a.ts", i=12345).endswith("_12345")
    assert one(spark, T.chunk_id(F.col("p"), F.col("i")), p="src/a.ts", i=7).endswith("_0007")
    assert one(spark, T.extension(F.col("p")), p="a/b.TS") == ".ts"
    assert one(spark, T.extension(F.col("p")), p="a/.json") == ""
    assert one(spark, T.last_segment(F.col("p")), p=".json") == ".json"
    assert one(spark, T.normal_dir(F.col("p")), p="./src/") == "src"
    assert one(spark, T.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, T.iso_time(F.col("n")), n=1700000000123) == "2023-11-14T22:13:20.123Z"
    assert one(spark, T.r4(F.col("x")), x=0.00005) == 0.0001


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0], [0.0, 0.0])], "v array<double>, z array<double>")
    r = df.select(V.truncate(F.col("v"), 2).alias("t"), V.normalize(F.col("z")).alias("z"), V.cosine_distance(F.col("v"), F.col("v")).alias("d")).first()
    assert r["t"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and abs(r["d"]) < 1e-12
