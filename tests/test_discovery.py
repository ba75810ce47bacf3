"""Files found by their footers; totals under names of one's own."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.sources import discovery

GROUPS = [["game_id"], ["player_id", "qb_id"], ["attempts", "pass_attempts"]]


@pytest.fixture
def root(tmp_path):
    write = lambda name, **cols: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), pq.write_table(pa.table(cols), tmp_path / name))
    write("a/players.parquet", game_id=[1, 1], qb_id=["x", "x"], attempts=[3, 4], extra=[0, 0])
    write("a/deep/er/qb_games.parquet", game_id=[1, 1, 2], player_id=["x", "x", None], pass_attempts=["3", "n/a", None], passing_tds=[1.0, float("nan"), 2.0])
    write("b/other.parquet", game_id=[1], attempts=[1])
    (tmp_path / "b/broken.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "b/notes.txt").write_text("game_id player_id attempts")
    return tmp_path


def test_files_are_found_by_their_columns(spark, root):
    files = discovery.footers(spark, str(root))
    got = {r.path.split("/")[-1]: (r.columns, r["rows"]) for r in files.collect()}
    assert got["broken.parquet"] == (None, None) and set(got) == {"players.parquet", "qb_games.parquet", "other.parquet", "broken.parquet"}
    assert got["qb_games.parquet"] == (["game_id", "player_id", "pass_attempts", "passing_tds"], 3)
    assert discovery.discover(spark, str(root), GROUPS, "qb").endswith("qb_games.parquet")
    assert discovery.discover(spark, str(root), GROUPS).endswith("players.parquet")
    with pytest.raises(FileNotFoundError):
        discovery.discover(spark, str(root), [*GROUPS, ["nowhere"]])


def test_no_data_page_is_read(spark, root):
    """A file whose pages are overwritten is found all the same: its footer is whole."""
    path = root / "a/deep/er/qb_games.parquet"
    data = bytearray(path.read_bytes())
    size = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - size] = b"\xff" * (len(data) - 12 - size)
    path.write_bytes(data)
    assert discovery.discover(spark, str(root), GROUPS, "qb").endswith("qb_games.parquet")
    with pytest.raises(Exception):
        spark.read.parquet(str(path)).collect()


def test_totals_under_own_names(spark, root):
    df = spark.read.parquet(str(root / "a/deep/er/qb_games.parquet"))
    key = {"game": ["game_id"], "player": ["player_id", "qb_id"]}
    got = discovery.totals(df, key, {"attempts": ["attempts", "pass_attempts"], "touchdowns": ["passing_tds"], "sacks": ["sacks"]}, ["sacks"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "x", 3.0, 1.0, 0.0), ("2", None, 0.0, 2.0, 0.0)]
    with pytest.raises(ValueError, match="no column for sacks"):
        discovery.totals(df, key, {"sacks": ["sacks"]})
