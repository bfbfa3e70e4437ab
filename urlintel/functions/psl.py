"""Registrable domains by the public-suffix list.

The rules are those of https://publicsuffix.org, kept whole with their licence notice (Mozilla Public License 2.0) in
``data/public_suffix_list.txt``; another list may be named by path.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_tables: dict[tuple[str, int, str | None], DataFrame] = {}
FEW = 100_000  # rules that go to every task; beyond it Spark decides how to join
HIT = "array<struct<e:int,length:int,private:boolean>>"


def ascii_form(suffix: str) -> str:
    """A suffix as it stands in an address of ASCII only: each label that isn't ASCII in Punycode."""
    return ".".join(x if x.isascii() else "xn--" + x.lower().encode("punycode").decode() for x in suffix.split("."))


@lru_cache(maxsize=4)
def rules(path: str | None = None) -> list[tuple[str, str, bool]]:
    """(suffix, kind, private): the list's rules, international ones in both forms; kind is plain, wild (any label before it) or except. About ten thousand."""
    if path is None:
        text = resources.files(__package__).joinpath("data/public_suffix_list.txt").read_text(encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    out, private = [], False
    for line in text.splitlines():
        private = private or "BEGIN PRIVATE" in line
        rule = line.strip()
        if not rule or rule.startswith("//"):
            continue
        if rule.startswith("*."):
            out.append((rule[2:], "wild", private))
        elif rule.startswith("!"):
            out.append((rule[1:], "except", private))
        else:
            out.append((rule, "plain", private))
    return out + [(ascii_form(s), kind, private) for s, kind, private in out if not s.isascii()]


def rule_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """tail, rules: the rules by the last label or the last two of their suffix, made once a session. Spark splits one text into its rows."""
    where = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), path)
    if where not in _tables:
        for gone in [k for k in _tables if k[0] != where[0]]:
            del _tables[gone]  # of applications that have ended
        groups: dict[str, list[str]] = {}
        for suffix, kind, private in rules(path):
            groups.setdefault(".".join(suffix.split(".")[-2:]), []).append(f"{suffix} {kind} {int(private)} {suffix.count('.') + 1}")
        text = "\n".join(f"{tail},{','.join(r)}" for tail, r in groups.items())

        def rule(r: Column) -> Column:
            cells = F.split(r, " ")
            return F.struct(cells[0].alias("suffix"), cells[1].alias("kind"), (cells[2] == "1").alias("private"), cells[3].cast("int").alias("size"))

        row = F.split("r", ",")
        lines = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", "\n")).alias("r"))
        _tables[where] = lines.select(row[0].alias("tail"), F.transform(F.slice(row, F.lit(2), F.size(row) - 1), rule).alias("rules"))
    return _tables[where]


def _domain(best: str, compat: bool) -> Column:
    """The domain of ``host`` by its winning rule, a struct of length and private."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    size = F.coalesce(f"{best}.length", F.lit(1))
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    naive = (n <= size) | ((n == size + 1) & (F.lit(True) if compat else F.coalesce(f"{best}.private", F.lit(False))))
    return F.when(n <= 1, F.col("host")).when(naive, two).otherwise(F.array_join(F.slice(labels, n - size, size + 1), "."))


def _hits(rules_: str, host: Column, n: Column) -> Column:
    """What the rules that the host ends in say of its suffix; exceptions first, then the longest wins."""

    def hit(r: Column) -> Column:
        length = F.when(r["kind"] == "wild", F.least(r["size"] + 1, n)).when(r["kind"] == "except", r["size"] - 1).otherwise(r["size"])
        return F.struct((r["kind"] == "except").cast("int").alias("e"), length.alias("length"), r["private"].alias("private"))

    mine = F.filter(rules_, lambda r: (host == r["suffix"]) | F.endswith(host, F.concat(F.lit("."), r["suffix"])))
    return F.coalesce(F.transform(mine, hit).cast(HIT), F.array().cast(HIT))


def with_registrable(df: DataFrame, compat: bool = False, path: str | None = None) -> DataFrame:
    """Add domain to rows with a host; null where host is null.

    Each row meets the rules for its last label and for its last two, two joins with a fixed table of some thousand rows
    that go to every task, so nothing is shuffled or aggregated and streams can use it too. One label is the suffix where
    no rule matches. A host that is a suffix itself, or equals its registrable domain under a private rule (any rule
    with ``compat``), falls back to its last two labels.
    """
    table, sent = rule_table(df.sparkSession, path), F.broadcast if len(rules(path)) <= FEW else lambda t: t
    host = F.lower("host")
    n = F.size(F.split("host", r"\."))
    out = df
    for i in (1, 2):
        tail = F.when(n >= i, F.substring_index(host, ".", -i))
        out = out.join(sent(table.select(F.col("tail").alias(f"_tail{i}"), F.col("rules").alias(f"_rules{i}"))), tail == F.col(f"_tail{i}"), "left").drop(f"_tail{i}")
    out = out.withColumn("_best", F.array_max(F.concat(_hits("_rules1", host, n), _hits("_rules2", host, n))))
    return out.withColumn("domain", F.when(F.col("host").isNotNull(), _domain("_best", compat))).drop("_best", "_rules1", "_rules2")
