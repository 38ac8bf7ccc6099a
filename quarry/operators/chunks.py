"""Chunking: flatten nested entities into (collection, chunk text, metadata).

Text templates mirror the reference's f-strings; Python's rendering of
optional values is kept (``None`` prints as ``None`` except where the
reference substitutes a default).  All templates are ``concat`` expressions
over nested columns (``transform``/``filter``/``array_join`` for inner lists),
so nested arrays are formatted in place with no re-aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ordering import positions_within
from quarry.functions.text import is_truthy_text, py_str

# Metadata tags written by the reference.
COMMENT_META = {"type": "comment", "source": "reddit"}
PLAYER_META = {"type": "player", "source": "knowledge_base"}
COACH_META = {"type": "coach", "source": "knowledge_base"}
CHAMPION_META = {"type": "champion", "source": "data_dragon"}
TOURNAMENT_META = {"type": "tournament", "source": "official"}


def _s(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_concat(*parts) -> Column:
    """concat of literals (str) and columns; null if any column is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def meta_map(fixed: dict, **cols) -> Column:
    """metadata MAP<STRING,STRING> from fixed tags plus column values."""
    kv = []
    for k, v in fixed.items():
        kv += [F.lit(k), F.lit(v)]
    for k, v in cols.items():
        kv += [F.lit(k), _s(v).cast("string")]
    return F.create_map(*kv)


# ------------------------------------------------------------------ comments

def comment_chunks(comments: DataFrame) -> DataFrame:
    """(doc_id, text, type, source, match, upvotes, metadata): one chunk per comment."""
    return comments.select(
        "doc_id", F.col("body").alias("text"),
        F.lit(COMMENT_META["type"]).alias("type"), F.lit(COMMENT_META["source"]).alias("source"),
        "match", F.col("score").alias("upvotes"),
        meta_map(COMMENT_META, match="match", upvotes="score").alias("metadata"))


# ------------------------------------------------------------------ profiles

def player_text() -> Column:
    return lit_concat(
        py_str("ign"), " (", py_str("real_name"), ") is a ", py_str("role"), " player for ",
        py_str("team"), ". Nationality: ", py_str("nationality"), ". Signature champions: ",
        F.array_join(F.coalesce(F.col("signature_champions"), F.array().cast("array<string>")), ", "),
        ". Playstyle: ", py_str("playstyle"), " Tournament performance: ",
        py_str("tournament_performance"), " Community sentiment: ",
        F.coalesce(F.col("community_sentiment"), F.lit("N/A")))


def player_chunks(players: DataFrame) -> DataFrame:
    return players.select(
        "ord", player_text().alias("text"), F.lit("player").alias("type"),
        F.col("ign").alias("name"), "team", "role",
        meta_map(PLAYER_META, name="ign", team="team", role="role").alias("metadata"))


def coach_chunks(coaches: DataFrame) -> DataFrame:
    """coaches: (ord, team, ign, real_name, nationality, background, tournament_role)."""
    text = lit_concat(
        "Coach ", py_str("ign"), " (", py_str("real_name"), ") coaches ", py_str("team"),
        ". Nationality: ", py_str("nationality"), ". Background: ", py_str("background"),
        " Tournament role: ", F.coalesce(F.col("tournament_role"), F.lit("N/A")))
    return coaches.select("ord", text.alias("text"), F.lit("coach").alias("type"),
                          F.col("ign").alias("name"), "team", F.lit(None).cast("string").alias("role"),
                          meta_map(COACH_META, name="ign", team="team").alias("metadata"))


# ----------------------------------------------------------------- champions

def champion_text() -> Column:
    roles = F.coalesce(F.col("roles"), F.array(F.coalesce(F.col("primary_role"), F.lit("Unknown"))))
    win = F.when(F.col("win_rate").isNotNull(),
                 F.concat(F.col("win_rate").cast("string"), F.lit("%"))).otherwise(F.lit("N/A"))
    base = lit_concat(
        py_str("name"), " (", F.coalesce(F.col("title"), F.lit("")), "): ",
        F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ", "),
        ". Played: ", F.array_join(roles, "/"),
        ". Pick/Ban presence: ", py_str("presence_pct"), "%. Games played: ", py_str("games_played"),
        ", Wins: ", py_str("wins"), ", Win rate: ", win, ". Banned ", py_str("bans"), " times. ")
    return F.concat(base, F.when(is_truthy_text("tournament_context"),
                                 F.concat(F.lit("Tournament context: "), F.col("tournament_context")))
                     .otherwise(F.lit("")))


def champion_chunks(champs: DataFrame) -> DataFrame:
    return champs.select(
        "ord", champion_text().alias("text"), F.col("name"), F.col("primary_role").alias("role"),
        F.col("presence_pct").alias("presence"),
        meta_map(CHAMPION_META, name="name", role="primary_role",
                 presence="presence_pct").alias("metadata"))


# ---------------------------------------------------------------- tournament

def games_suffix(games: str = "games") -> Column:
    """`` Game {n}: {notable}.`` for every game whose notable is non-empty."""
    kept = F.filter(F.coalesce(F.col(games), F.array().cast("array<struct<game:int,notable:string>>")),
                    lambda g: F.coalesce(g["notable"], F.lit("")) != F.lit(""))
    return F.array_join(F.transform(kept, lambda g: F.concat(
        F.lit(" Game "), g["game"].cast("string"), F.lit(": "), g["notable"], F.lit("."))), "")


def narratives_suffix(narratives: str = "narratives") -> Column:
    arr = F.coalesce(F.col(narratives), F.array().cast("array<string>"))
    return F.array_join(F.transform(arr, lambda n: F.concat(F.lit(" "), n, F.lit("."))), "")


def match_text(kind: str = "group") -> Column:
    """``group``: stage line + games; ``semi``: + narratives; ``final``: fixed stage
    label and MVP, + games and narratives."""
    if kind == "final":
        head = lit_concat("Grand Finals: ", py_str("team1"), " vs ", py_str("team2"), ". Winner: ",
                          py_str("winner"), " (", py_str("score"), "). MVP: ", py_str("mvp"), ". ",
                          py_str("summary"))
    else:
        head = lit_concat(py_str("stage"), ": ", py_str("team1"), " vs ", py_str("team2"),
                          ". Winner: ", py_str("winner"), " (", py_str("score"), "). ", py_str("summary"))
    out = F.concat(head, games_suffix())
    if kind in ("semi", "final"):
        out = F.concat(out, narratives_suffix())
    return out


def match_chunks(matches: DataFrame, kind: str = "group") -> DataFrame:
    stage = F.lit("Grand Finals") if kind == "final" else F.col("stage")
    return matches.select(
        "ord", match_text(kind).alias("text"), F.col("match_label").alias("match"),
        stage.alias("stage"),
        meta_map(dict(TOURNAMENT_META, subtopic="match_result"), match="match_label",
                 stage=stage).alias("metadata"))


def overview_chunk(t: DataFrame) -> DataFrame:
    text = lit_concat("Tournament: ", py_str("name"), ", held at ", py_str("location"), " from ",
                      py_str(F.col("dates.start")), " to ", py_str(F.col("dates.end")), ". Format: ",
                      py_str("format"), ". Champion: ", py_str("champion"), ". Runner-up: ",
                      py_str("runner_up"), ".")
    return t.select(text.alias("text"),
                    meta_map(dict(TOURNAMENT_META, subtopic="overview")).alias("metadata"))


def narrative_chunks(narratives: DataFrame) -> DataFrame:
    """narratives: (ord, narrative, description)."""
    text = lit_concat("Tournament narrative — ", py_str("narrative"), ": ", py_str("description"))
    return narratives.select("ord", text.alias("text"),
                             meta_map(dict(TOURNAMENT_META, subtopic="narrative")).alias("metadata"))


def team_chunks(teams: DataFrame) -> DataFrame:
    """teams: (ord, abbr, full_name, region, seed, result, roster MAP<role, STRUCT<name,...>>,
    coach STRING raw JSON).  A coach is named only when it is a JSON object."""
    roster = F.array_join(F.transform(F.map_entries(F.col("roster")), lambda e: F.concat(
        py_str(e["value"]["name"]), F.lit(" ("), e["key"], F.lit(")"))), ", ")
    coach_obj = F.from_json(F.col("coach"), "ign STRING")
    coach = F.when(F.ltrim(F.col("coach")).startswith("{"),
                   F.concat(F.lit(" Coach: "), py_str(coach_obj["ign"]))).otherwise(F.lit(""))
    text = lit_concat("Team ", py_str("full_name"), " (", py_str("abbr"), "), ", py_str("region"), " ",
                      py_str("seed"), ". Result: ", py_str("result"), ". Roster: ", roster, ".", coach)
    return teams.select("ord", text.alias("text"),
                        meta_map(dict(TOURNAMENT_META, subtopic="team_roster"), team="abbr")
                        .alias("metadata"))


# ------------------------------------------------------------------ assembly

def union_chunks(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def assign_chunk_ids(chunks: DataFrame, collection_col: str = "collection",
                     ord_col: str = "ord") -> DataFrame:
    """``chunk_id = "{collection}_{i}"``, i = 0-based position in ``ord`` order
    within the collection (skew-safe numbering); ``chunk_pos`` keeps i."""
    pos = positions_within(chunks, [collection_col], [F.asc(ord_col)], out="chunk_pos")
    return pos.withColumn("chunk_id", F.concat(F.col(collection_col), F.lit("_"),
                                               F.col("chunk_pos").cast("string")))


def parse_chunk_pos(chunk_id, collection: str) -> Column:
    """Inverse of the positional id (integer after the ``{collection}_`` prefix)."""
    return F.replace(_s(chunk_id), F.lit(f"{collection}_"), F.lit("")).cast("bigint")
