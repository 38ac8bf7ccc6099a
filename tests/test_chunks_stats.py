"""Nested sources, chunk templates and statistics rules on hand-made rows."""

import json

from conftest import rows
from pyspark.sql import functions as F

from quarry.operators import chunks as ch
from quarry.operators import stats as stt
from quarry.sources import files as fl

GAME = "array<struct<game:int,notable:string>>"


def test_games_appended_only_when_notable(spark):
    m = spark.createDataFrame(
        [(0, "Groups", "A", "B", "A", "2-0", "Close.", "m0", [], None),
         (1, "Groups", "A", "B", "B", "1-2", "Long.", "m1",
          [(1, None), (2, ""), (3, "Baron steal")], None),
         (2, "Semis", "C", "D", "C", "3-0", "Sweep.", "m2", None, ["Crowd loud", "Record"])],
        f"ord long, stage string, team1 string, team2 string, winner string, score string, "
        f"summary string, match_label string, games {GAME}, narratives array<string>")
    got = dict(rows(ch.match_chunks(m, "semi"), "ord", "text"))
    assert got[0] == "Groups: A vs B. Winner: A (2-0). Close."
    assert got[1] == "Groups: A vs B. Winner: B (1-2). Long. Game 3: Baron steal."
    assert got[2] == "Semis: C vs D. Winner: C (3-0). Sweep. Crowd loud. Record."


def test_coach_struct_string_absent(spark):
    roster = {"top": {"name": "P1", "nationality": "X"}, "mid": {"name": "P2", "nationality": "Y"}}
    t = spark.createDataFrame(
        [(0, "AAA", "Team A", "EU", "1", "Champion", roster, json.dumps({"ign": "Coachy", "real_name": "C"})),
         (1, "BBB", "Team B", "NA", "2", "Groups", roster, "Plain Name"),
         (2, "CCC", "Team C", "KR", "3", "Semis", roster, None)],
        "ord long, abbr string, full_name string, region string, seed string, result string, "
        "roster map<string,struct<name:string,nationality:string>>, coach string")
    got = dict(rows(ch.team_chunks(t), "ord", "text"))
    assert got[0].endswith("Roster: P1 (top), P2 (mid). Coach: Coachy")
    assert got[1].endswith("Roster: P1 (top), P2 (mid).")
    assert got[2].endswith("Roster: P1 (top), P2 (mid).")


def test_guarded_rate_null_and_half_even(spark):
    d = spark.createDataFrame([(0, 0), (1, 16), (5, 8), (3, 80), (7, 20)], "wins long, games long")
    got = [r[0] for r in rows(d.select(stt.guarded_rate("wins", "games")))]
    # 6.25 -> 6.2 and 3.75 -> 3.8 (ties to even), 62.5 -> 62.5, 35.0
    assert got == [None, 6.2, 62.5, 3.8, 35.0]


def test_stable_sort_keeps_input_order_on_ties(spark):
    d = spark.createDataFrame([(0, 50.0), (1, 70.0), (2, 50.0), (3, 70.0), (4, 10.0)],
                              "ord long, presence double")
    got = sorted(rows(stt.stable_sort_desc(d, "presence", "ord"), "pos", "ord"))
    assert [o for _, o in got] == [1, 3, 0, 2, 4]


def test_ordered_members_and_join(spark):
    d = spark.createDataFrame([(0, "Mid", "a", 10.0), (1, "Top", "b", 30.0), (2, "Mid", "c", 30.0),
                               (3, "Mid", "d", 10.0)], "ord long, role string, name string, presence double")
    m = stt.ordered_members(d, "role", "presence", "ord")
    joined = dict(rows(stt.join_members(m, "role", "pos", "name")))
    assert joined == {"Mid": "c, a, d", "Top": "b"}
    extra = spark.createDataFrame([(9, "Coach", "z", 0.0)], "ord long, role string, name string, presence double")
    m2 = m.unionByName(stt.ordered_members(extra, "role", "presence", "ord"))
    shown = rows(stt.in_role_order(m2, "role", ("Top", "Jungle", "Mid")), "role_ord", "role")
    assert sorted(set(shown)) == [(0, "Top"), (2, "Mid")]  # fixed order; unknown role not shown


def test_json_map_keeps_file_order_and_null_map(spark, tmp_path):
    doc = {"players": {"Zed": {"ign": "Zed", "team": "T1"}, "Amy": {"ign": "Amy", "team": "T2"}},
           "coaches": None}
    p = tmp_path / "players.json"
    p.write_text(json.dumps(doc, indent=2))
    schema = ("players map<string,struct<ign:string,team:string>>, "
              "coaches map<string,struct<ign:string>>")
    d = fl.read_json_document(spark, str(p), schema)
    assert rows(fl.explode_map(d, "players"), "ord", "key", "team") == [(0, "Zed", "T1"), (1, "Amy", "T2")]
    assert fl.explode_map(d, "coaches").count() == 0


def test_player_chunk_defaults(spark):
    p = spark.createDataFrame([(0, "Ign", "Real", "Top", "T", "KR", ["A", "B"], "Aggressive.", "Great.", None)],
                              "ord long, ign string, real_name string, role string, team string, "
                              "nationality string, signature_champions array<string>, playstyle string, "
                              "tournament_performance string, community_sentiment string")
    text = rows(ch.player_chunks(p), "text")[0][0]
    assert text == ("Ign (Real) is a Top player for T. Nationality: KR. Signature champions: A, B. "
                    "Playstyle: Aggressive. Tournament performance: Great. Community sentiment: N/A")


def test_chunk_ids_and_parse(spark):
    c = spark.createDataFrame([("comments", o) for o in (5, 3, 9)], "collection string, ord long")
    got = sorted(rows(ch.assign_chunk_ids(c).select(
        "ord", "chunk_id", ch.parse_chunk_pos("chunk_id", "comments").alias("p"))))
    assert got == [(3, "comments_0", 0), (5, "comments_1", 1), (9, "comments_2", 2)]


def test_count_by_label_strips_suffixes(spark):
    d = spark.createDataFrame([("A vs B (Series)",), ("A vs B - Game 1",), ("A vs B - Game 2",), ("C",)],
                              "match string")
    got = sorted(rows(stt.count_by_label(d)))
    assert got == [("A vs B", 3, 4), ("C", 1, 4)]
    assert sum(n for _, n, _ in got) == got[0][2]


def test_overview_final_and_narratives(spark, tmp_path):
    doc = {"tournament": {"name": "Cup", "location": "Town", "dates": {"start": "d1", "end": "d2"},
                          "format": "Bo5", "champion": "A", "runner_up": "B"},
           "bracket": {"knockout_stage": {"finals": {
               "match_label": "F1", "team1": "A", "team2": "B", "winner": "A", "score": "3-1",
               "mvp": "Star", "summary": "Great.", "games": [{"game": 1, "notable": "Fast"}],
               "narratives": ["Comeback"]}}},
           "key_narratives": [{"narrative": "N1", "description": "D1"}]}
    p = tmp_path / "t.json"
    p.write_text(json.dumps(doc))
    match = ("struct<match_label:string,team1:string,team2:string,winner:string,score:string,mvp:string,"
             "summary:string,games:array<struct<game:int,notable:string>>,narratives:array<string>>")
    schema = (f"tournament struct<name:string,location:string,dates:struct<start:string,end:string>,"
              f"format:string,champion:string,runner_up:string>, "
              f"bracket struct<knockout_stage:struct<finals:{match}>>, "
              f"key_narratives array<struct<narrative:string,description:string>>")
    d = fl.read_json_document(spark, str(p), schema)
    ov = rows(ch.overview_chunk(d.select("tournament.*")), "text")[0][0]
    assert ov == "Tournament: Cup, held at Town from d1 to d2. Format: Bo5. Champion: A. Runner-up: B."
    fin = d.select("bracket.knockout_stage.finals.*").withColumn("ord", F.lit(0))
    t = rows(ch.match_chunks(fin, "final"), "text", "stage")[0]
    assert t == ("Grand Finals: A vs B. Winner: A (3-1). MVP: Star. Great. Game 1: Fast. Comeback.", "Grand Finals")
    nar = d.selectExpr("posexplode(key_narratives) AS (ord, n)").select("ord", "n.*")
    assert rows(ch.narrative_chunks(nar), "text") == [("Tournament narrative — N1: D1",)]
