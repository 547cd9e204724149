"""Secret scans with multipart credential linking, by DataFrame functions alone.

Strong spans (assigned secrets, access identifiers, hexadecimal keys) are always reported.
Weak candidates (account names, mixed runs of forty characters, service addresses) are
reported only when a complementary part stands within the same scope: an interval join of
candidates with parts, on the document and a grid of positions, decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matches import match_sizes, positions
from .storage import staged

#: Characters between two parts of one credential at most.
SCOPE = 200
#: Width of the grid that the interval join meets on.
CELL = 1024

_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""


def _either_case(pattern: str) -> str:
    """A pattern of words whose letters, ASCII alone, stand in either case; engines fold beyond ASCII in different ways."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() else c for c in pattern)


#: kind, the part of a credential it is, whether it is weak, pattern, group whose size counts, least and most size.
KINDS = [
    ("assign", "secret", False, rf"(?:{_either_case('password|passwd|secret|token|api_?key')}){_ASSIGN}([A-Za-z0-9+/_.=-]+)", 1, 8, None),
    ("access", "identifier", False, r"AKIA[A-Z0-9]+", None, 16, None),
    ("hex", "secret", False, r"[0-9a-f]{32,}", None, 32, None),
    ("account", "identifier", True, rf"(?:{_either_case('user(?:name)?|login|account|client_?id')}){_ASSIGN}([A-Za-z0-9_.@-]+)", 1, 3, None),
    ("run40", "secret", True, r"[A-Za-z0-9/+]{40,}", None, 40, 40),
    ("address", "endpoint", True, r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", None, 10, None),
]


def _parts(found: DataFrame) -> DataFrame:
    """Every span of every kind: rid, kind, rank, part, weak, start, end."""
    by_rank = lambda n: F.element_at(F.array(*(F.lit(k[n]) for k in KINDS)), F.col("rank") + 1)
    kinds = F.array(*(F.struct(F.lit(rank).alias("rank"), F.col(k[0]).alias("matches")) for rank, k in enumerate(KINDS)))
    some = found.select("rid", F.explode(F.filter(kinds, lambda k: F.size(k["matches"]) > 0)).alias("k"))
    sizes = some.select("rid", F.col("k.rank").alias("rank"), F.posexplode("k.matches").alias("nth", "m")).select("rid", "rank", "nth", "m.*")
    right = (F.col("inner") >= by_rank(5)) & (F.col("inner") <= F.coalesce(by_rank(6), F.lit((1 << 31) - 1)))
    return positions(sizes, ["rid", "rank"]).where(right).select("rid", by_rank(0).alias("kind"), "rank", by_rank(1).alias("part"), by_rank(2).alias("weak"), "start", "end")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak candidates with a complementary part in scope. Neither side meets more than the parts of a grid cell."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / CELL), F.floor(high / CELL)))
    weak = parts.where("weak").withColumn("cell", cells(F.col("start"), F.col("end")))
    reach = parts.select(F.col("rid").alias("o_rid"), F.col("part").alias("o_part"), F.col("weak").alias("o_weak"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    reach = reach.withColumn("o_cell", cells(F.col("o_start") - scope, F.col("o_end") + scope))
    apart = (F.col("o_start") >= F.col("end")) | (F.col("start") >= F.col("o_end"))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope)
    complement = (
        ((F.col("part") == "identifier") & (F.col("o_part") == "secret"))
        | ((F.col("part") == "secret") & (F.col("o_part") == "identifier"))
        | ((F.col("part") == "endpoint") & (F.col("o_part") != "endpoint") & ~F.col("o_weak"))
    )
    met = (F.col("rid") == F.col("o_rid")) & (F.col("cell") == F.col("o_cell")) & apart & near & complement
    return weak.join(reach, met, "left_semi").drop("cell").distinct()


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, text_hash (xxhash64 of the text) and spans, an
    array of (start, rank, end, kind, weak, reach) in order of start and kind; code points, end exclusive. ``reach``
    is the furthest end of the spans before, null for the first.

    Texts are read once; what follows works on sizes of matches, which are written to the shared folder.
    A null text is empty and has no spans. Repeated rows are scanned on their own; null ids are
    kept; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = [match_sizes(F.col("text"), F.lit(pattern), group=group).alias(kind) for kind, _, _, pattern, group, _, _ in KINDS]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("key"), text.alias("text"))
    found = staged(rows.select("rid", "key", F.xxhash64("text").alias("text_hash"), *sizes), "secrets")
    parts = staged(_parts(found), "secret-parts")
    kept = parts.where("not weak").unionByName(_linked(parts, scope))
    before = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("reach", F.max("end").over(before))
    spans = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "weak", "reach"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return found.select("rid", "key", "text_hash").join(spans, "rid", "left").select(F.col("key").alias(id_col), "text_hash", F.coalesce("spans", none).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of :func:`scan_secrets` replaced by ``mask``; overlapping spans become one. All columns stay, clean rows as they are, null texts null; repeated rows are masked alike."""
    found = scan_secrets(docs, id_col, text_col, scope).where(F.size("spans") > 0)
    found = found.groupBy(F.col(id_col).alias("__key"), F.col("text_hash").alias("__hash")).agg(F.first("spans").alias("__spans"))
    met = docs[id_col].eqNullSafe(found["__key"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["__hash"])
    text, spans = F.col(text_col), F.col("__spans")
    # each span writes the text between the furthest end before it and its own start, then the mask, unless it overlaps what is masked
    reach = lambda s: F.coalesce(s["reach"], F.lit(0)).cast("int")
    piece = lambda s: F.when(s["start"] >= reach(s), F.concat(F.substring(text, reach(s) + 1, (s["start"] - reach(s)).cast("int")), F.lit(mask))).otherwise("")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    tail = F.substring(text, last.cast("int") + 1, F.length(text))
    masked = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    columns = [F.when(spans.isNull(), text).otherwise(masked).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return docs.join(found, met, "left").select(*columns)


def _joined(spans, keep=None):
    spans = spans if keep is None else F.filter(spans, keep)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan_secrets`: n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.col("spans"), lambda s: ~s["weak"])
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def secret_oracle() -> str:
    """DuckDB SQL for the digests of table documents."""
    rows = []
    for rank, (kind, part, weak, pattern, group, least, most) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        inner = f"regexp_extract_all(t, {p}, {group or 0})"
        rows.append(
            f"select k, '{kind}' kind, {rank} rnk, '{part}' part, {weak} weak, g, h, n, i from (select k, "
            f"unnest(list_transform(regexp_split_to_array(t, {p}), lambda x: length(x))[1:len(regexp_extract_all(t, {p}, 0))]) g, "
            f"unnest(list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x))) h, unnest(list_transform({inner}, lambda x: length(x))) n, "
            f"generate_subscripts(regexp_extract_all(t, {p}, 0), 1) i from d where regexp_matches(t, {p}))"
        )
    sizes = " or ".join(f"(kind = '{k}' and n >= {a}" + (f" and n <= {b}" if b else "") + ")" for k, _, _, _, _, a, b in KINDS)
    text = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rnk) filter ({where}), '')"
    count = lambda kind: f"count(*) filter (kind = '{kind}') n_{kind}"
    return f"""
with d as (select doc_id k, coalesce(text, '') t from documents),
m as ({" union all ".join(rows)}),
p as (select k, kind, rnk, part, weak, (sum(g + h) over w)::bigint e, (sum(g + h) over w)::bigint - h s, n from m window w as (partition by k, kind order by i)),
q as (select * from p where {sizes}),
v as (select * from q where not weak or exists (select 1 from q o where o.k = q.k and (o.s >= q.e or q.s >= o.e) and o.s <= q.e + {SCOPE} and q.s <= o.e + {SCOPE}
  and ((q.part = 'identifier' and o.part = 'secret') or (q.part = 'secret' and o.part = 'identifier') or (q.part = 'endpoint' and o.part <> 'endpoint' and not o.weak))))
select d.k doc_id, {count("assign")}, {count("access")}, {count("hex")}, sha256({text("not weak and kind is not null")}) base_sha256, {text("kind is not null")} spans
from d left join v on v.k = d.k group by d.k"""
