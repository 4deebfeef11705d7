"""Registered queries of fuzzy resolution over shows whose likeness is known by construction, so that SQL can say the result.

Shows come in groups of up to four: 0 is stored; 1 has three characters more in its title, a ratio of 2 * 37 / 77 with 0; 2 has
fourteen more, too few shared ones; 3 has the title of 0 and comes half an hour later, in some groups a minute more, at the
same place or another. Titles, venues and addresses of different groups are digests, which are never alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.functions import text as t
from listingloom.operators import resolve as r
from listingloom.plans.bindings import bound, cte

_STAGED = "v IN (1, 3)"
#: Whether the show 3 of a group is near in time to show 0; and whether its place lets it be the same.
_NEAR, _PLACE = "g % 3 <> 0", "(g % 2 = 0 OR g % 5 = 0)"
_SEEN = "2026-08-01"


def _shows(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "shows")


def _stored(s: SparkSession, d: str) -> DataFrame:
    return _shows(s, d).where("v = 0").withColumn("id", F.concat(F.lit("s"), F.col("n")))


def _incoming(s: SparkSession, d: str) -> DataFrame:
    return _shows(s, d).where(_STAGED).withColumn("id", F.concat(F.lit("n"), F.col("n")))


def _aliases(s: SparkSession, d: str) -> DataFrame:
    """Of every fourth group show 0 has a page of its own, which show 3 names too."""
    return _stored(s, d).where("g % 4 = 1").select(F.col("id").alias("event_id"), F.concat(F.lit("shows.example.com/show-"), F.col("g")).alias("canonical_url"), "url", "source_id", F.lit("2026-07-01").alias("first_seen"), F.lit("2026-07-01").alias("last_seen"))


def _finalized(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups 5, 11, ... have nothing stored: show 1 is new, and show 3 meets it. Show 1 brings a price to even groups."""
    seen = [F.lit(_SEEN).alias("first_seen"), F.lit(_SEEN).alias("last_seen")]
    staged = _incoming(s, d).withColumns({"url": F.lit(""), "price": F.when(F.expr("v = 1 AND g % 2 = 0"), "$5").otherwise("")}).select("*", F.array().cast("array<string>").alias("raw_keys"), *seen)
    stored = _stored(s, d).where("g % 6 <> 5").withColumns({"url": F.lit(""), "price": F.lit("")}).select("*", F.lit("2026-07-01").alias("first_seen"), F.lit("2026-07-01").alias("last_seen"))
    none = s.createDataFrame([], "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string")
    return r.finalize(staged, stored, none, _SEEN)


_OUTCOMES = f"""{cte('shows')}, p AS (SELECT g, max(n) FILTER (v = 0 AND g % 6 <> 5) AS old, max(n) FILTER (v = 1) AS one, max(n) FILTER (v = 3) AS three FROM shows GROUP BY g),
 first AS (SELECT *, CASE WHEN old IS NOT NULL AND one IS NOT NULL THEN 's' || old WHEN one IS NOT NULL THEN 'n' || one END AS of_one FROM p),
 second AS (SELECT *, CASE WHEN old IS NOT NULL THEN CASE WHEN {_NEAR} AND {_PLACE} THEN 's' || old END WHEN {_PLACE} THEN of_one END AS met FROM first),
 outcomes AS (SELECT one AS n, of_one AS event_id, CASE WHEN old IS NULL THEN 'new' WHEN g % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM second WHERE one IS NOT NULL
  UNION ALL SELECT three, coalesce(met, 'n' || three), CASE WHEN met IS NULL THEN 'new' WHEN one IS NOT NULL THEN 'duplicate' ELSE 'unchanged' END FROM second WHERE three IS NOT NULL)"""

QUERIES = {
    "res5_show_pairs": (
        lambda s, d: r.score_pairs(_shows(s, d), _shows(s, d), "n", "n", t.norm_ascii, distinct=True).select("l_key", "r_key", F.round("title_score", 6).alias("title_score")),
        f"""{cte('shows')} SELECT a.n AS l_key, b.n AS r_key, CASE WHEN a.v = 1 OR b.v = 1 THEN round(74 / 77, 6) ELSE 1.0 END AS title_score FROM shows a JOIN shows b ON a.g = b.g AND a.n < b.n
        WHERE (a.v, b.v) IN ((0, 1), (0, 3), (1, 3)) AND (b.v = 1 OR {_PLACE.replace('g ', 'a.g ')}) AND ((a.v, b.v) <> (0, 3) OR {_NEAR.replace('g ', 'a.g ')})""",
    ),
    "res3_show_occurrences": (
        lambda s, d: r.match_occurrence(_incoming(s, d), _stored(s, d), t.norm_ascii),
        f"{cte('shows')} SELECT i.n, 's' || e.n AS event_id FROM shows i JOIN shows e ON e.g = i.g AND e.v = 0 WHERE i.v = 1 OR i.v = 3 AND i.{_NEAR} AND {_PLACE.replace('g ', 'i.g ')}",
    ),
    "res4_show_resolution": (
        lambda s, d: r.resolve(_incoming(s, d), _aliases(s, d), _stored(s, d), t.norm_ascii),
        f"""{cte('shows')} SELECT i.n, CASE WHEN x.how <> 'new' THEN 's' || e.n END AS event_id, x.how FROM shows i LEFT JOIN shows e ON e.g = i.g AND e.v = 0,
        LATERAL (SELECT CASE WHEN e.n IS NULL THEN 'new' WHEN i.v = 3 AND i.g % 4 = 1 THEN 'alias' WHEN i.v = 1 OR i.{_NEAR} AND {_PLACE.replace('g ', 'i.g ')} THEN 'occurrence' ELSE 'new' END AS how) x WHERE i.{_STAGED}""",
    ),
    "upd4_show_outcomes": (lambda s, d: _finalized(s, d)[2], f"{_OUTCOMES} SELECT * FROM outcomes"),
    "upd4_show_store": (
        lambda s, d: _finalized(s, d)[0].select("id", "title", "start", "price", "first_seen", "last_seen"),
        f"""{_OUTCOMES} SELECT 's' || s.n AS id, title, start, CASE WHEN g % 2 = 0 AND one IS NOT NULL THEN '$5' ELSE '' END AS price, '2026-07-01' AS first_seen,
          CASE WHEN 's' || s.n IN (SELECT event_id FROM outcomes) THEN '{_SEEN}' ELSE '2026-07-01' END AS last_seen FROM shows s JOIN second USING (g) WHERE s.n = old
        UNION ALL SELECT event_id, title, start, CASE WHEN s.v = 1 AND s.g % 2 = 0 THEN '$5' ELSE '' END, '{_SEEN}', '{_SEEN}' FROM outcomes o JOIN shows s ON s.n = o.n WHERE outcome = 'new'""",
    ),
}
