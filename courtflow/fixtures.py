"""Match tables derived from the driver's parquet tables.

Each table is one SELECT that Spark SQL and other ANSI engines read alike
(double literals carry an exponent, integer division is ``floor`` of a
quotient), so a check query can rebuild the same input. All derivations are
row-local: no window, no shuffle, and no match grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtflow.config import COURT_LENGTH_M


def _div(a: str, b: int) -> str:
    return f"cast(floor({a} / {b}) as bigint)"


def num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


_K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"
_ROLE = "case event_id % 4 when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' else 'OPPONENT_2' end"
_TYPE = (
    "case {k} when 0 then 'SERVE' when 1 then 'RETURN' when 2 then 'DRIVE' when 3 then 'DROP' when 4 then 'DINK' "
    "when 5 then 'VOLLEY' when 6 then 'OVERHEAD' when 7 then 'OTHER' else 'UNKNOWN' end"
)
_HITTER = "case {k} when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' when 3 then 'OPPONENT_2' else 'UNKNOWN' end"

# 100 frames x 4 roles per match at 30 fps.
RAW_POSITIONS = f"""
select match_id, role, frame, frame / 30e0 as t_s,
  case when k in (10, 11) then null else 3e0 + 2e0 * sin(frame / 15e0 + r) + value / 1500e0 end as x_m,
  case when k in (10, 11) then null
       when r < 2 then 3.4e0 + 1.8e0 * cos(frame / 20e0 + r)
       else {num(COURT_LENGTH_M)} - (3.4e0 + 1.8e0 * cos(frame / 20e0 + r)) end as y_m,
  40625e-5 + k * 3 / 512e0 as confidence,
  case when k < 4 then 'outside' when k < 8 then 'ambiguous' when k < 30 then 'near' else 'inside' end as region,
  case when k = 12 then 'suspected_identity_switch' when k in (10, 11) then 'temporarily_missing'
       when k % 17 = 5 then 'reacquired' else 'observed' end as state
from (select {_div('event_id', 400)} as match_id, {_div('event_id % 400', 4)} as frame, event_id % 4 as r,
             {_ROLE} as role, {_K} as k, value from events) e
"""

RALLIES = f"""
select {_div('event_id', 400)} as match_id, event_id % 400 as rally_id,
  25 * (event_id % 400) as start_frame, 25 * (event_id % 400) + 19 as end_frame,
  25 * (event_id % 400) / 30e0 as start_s, (25 * (event_id % 400) + 19) / 30e0 as end_s,
  5e-1 + 1e-1 * (event_id % 400) as confidence
from events where event_id % 400 < 4
"""

# A rally table and its shots in star form: one rally per order.
STAR_RALLIES = """
select o_custkey as match_id, o_orderkey as rally_id, o_orderkey % 9000 as start_frame,
  o_orderkey % 9000 / 30e0 as start_s, o_orderkey % 9000 / 30e0 + 1e0 + o_totalprice / 7e4 as end_s,
  2e-1 + (o_orderkey % 80) / 101e0 as confidence
from orders
"""

SHOTS = f"""
select o_custkey as match_id, l_orderkey as rally_id,
  l_orderkey * 100000000 + cast(floor(l_extendedprice * 1e2) as bigint) * 8 + l_linenumber as shot_id,
  cast(l_linenumber as bigint) as shot_index,
  {_HITTER.format(k='(l_suppkey % 5)')} as hitter_id, {_TYPE.format(k='(l_partkey % 9)')} as shot_type,
  4e-1 + (l_partkey % 60) / 101e0 as confidence, 3e-1 + (l_suppkey % 70) / 103e0 as hitter_confidence,
  case when l_linenumber = 7 then null else l_quantity / 50e0 * 6e0 end as hitter_x_m,
  case when l_linenumber = 7 then null else (l_partkey % 134) / 1e1 end as hitter_y_m,
  case l_suppkey % 4 when 0 then 'near' when 1 then 'ambiguous' else 'inside' end as hitter_region
from lineitem join orders on l_orderkey = o_orderkey
"""

# Ball timeline: 1000 frames per match; bursts of 160 moving frames, 90 quiet ones.
BALL = f"""
select match_id, frame, frame / 30e0 as t_s,
  case when k < 6 then 'UNKNOWN' when k < 20 then 'INTERPOLATED' else 'OBSERVED' end as status,
  case when k < 6 then null else {_div('frame', 50)} end as segment_id,
  case when k < 6 then null when frame % 250 < 160 then 960e0 + 700e0 * sin(frame / 9e0) + value / 1e2 else 960e0 + k / 5e1 end as x_px,
  case when k < 6 then null when frame % 250 < 160 then 300e0 + 400e0 * abs(sin(frame / 6e0)) + value / 1e2
       else 650e0 + (k % 7) / 5e0 end as y_px,
  3e-1 + k / 143e0 as confidence, k
from (select {_div('event_id', 1000)} as match_id, event_id % 1000 as frame, {_K} as k, value from events) e
"""

AUDIO = f"""
select {_div('event_id', 1000)} as match_id, event_id as transient_id,
  (event_id % 1000) / 30e0 + (k - 50) / 1e3 as video_s, (k % 50) / 51e0 as confidence
from (select *, {_K} as k from events) e where k % 4 = 0
"""

TRUTH = f"""
select {_div('event_id', 1000)} as match_id, event_id as event_id,
  (event_id % 1000) / 30e0 + (k - 50) * 4e-3 as t_s, event_id % 1000 as frame,
  {_HITTER.format(k='(k % 5)')} as player_id, {_TYPE.format(k='(k % 9)')} as shot_type
from (select *, {_K} as k from events) e where k % 5 <> 0 and event_id % 7 = 3
"""

# Boxes per frame (frame = order) with shifted truth boxes.
BOXES = """
select l_orderkey as frame_id, l_orderkey * 100000000 + cast(floor(l_extendedprice * 1e2) as bigint) * 8 + l_linenumber as box_id,
  l_quantity * 20e0 as l, l_extendedprice % 700e0 as t,
  l_quantity * 20e0 + 30e0 + 250e0 * l_tax as r, l_extendedprice % 700e0 + 30e0 + 250e0 * l_tax as b,
  2e-1 + 8e0 * l_discount + (l_partkey % 97) / 1e5 as confidence, cast(l_suppkey % 3 as bigint) as crop_id
from lineitem
"""

TRUTH_BOXES = """
select l_orderkey as frame_id, l_orderkey * 100000000 + cast(floor(l_extendedprice * 1e2) as bigint) * 8 + l_linenumber as truth_id,
  l_quantity * 20e0 + l_suppkey % 7 as l, l_extendedprice % 700e0 as t,
  l_quantity * 20e0 + 30e0 + 250e0 * l_tax + l_suppkey % 7 as r, l_extendedprice % 700e0 + 30e0 + 250e0 * l_tax as b,
  case l_suppkey % 3 when 0 then 'near' when 1 then 'far' else 'unknown' end as side
from lineitem where l_partkey % 3 <> 0
"""

# Person boxes per match and frame, with the ball near one of them at times.
PLAYER_BOXES = f"""
select match_id, frame, role, r,
  1e2 + 450e0 * r + (value * 3e0) % 150e0 as l, 250e0 + (value * 7e0) % 90e0 as t,
  1e2 + 450e0 * r + (value * 3e0) % 150e0 + 120e0 as r_px, 250e0 + (value * 7e0) % 90e0 + 330e0 as b,
  40625e-5 + k * 3 / 512e0 as tracking_confidence,
  case when k % 11 = 0 then 'reacquired' when k % 23 = 0 then 'suspected_identity_switch' else 'observed' end as state,
  case when r < 2 then 'near_side' else 'far_side' end as side,
  case when k < 25 then 'near' when k < 30 then 'ambiguous' else 'inside' end as region
from (select {_div('event_id', 1000)} as match_id, event_id % 1000 as frame, 0 as r, 'ME' as role, {_K} as k, value from events
      union all select {_div('event_id', 1000)}, event_id % 1000, 1, 'PARTNER', {_K}, value + 11e0 from events
      union all select {_div('event_id', 1000)}, event_id % 1000, 2, 'OPPONENT_1', {_K}, value + 23e0 from events
      union all select {_div('event_id', 1000)}, event_id % 1000, 3, 'OPPONENT_2', {_K}, value + 37e0 from events) e
"""

ANNOTATIONS = """
select conv_id as match_id, turn as event_id, turn * 30 + length(text) % 7 as frame,
  case when turn % 5 = 4 then 'BOUNCE' when turn % 2 = 0 then 'RALLY_START' else 'RALLY_END' end as type
from conversations
"""

CORRECTIONS = f"""
select o_custkey as match_id, l_orderkey * 100000000 + cast(floor(l_extendedprice * 1e2) as bigint) * 8 + l_linenumber as correction_id,
  case l_suppkey % 4 when 0 then 'shot_type' when 1 then 'hitter' when 2 then 'rally_boundary' else 'player_identity' end as type,
  case when l_suppkey % 4 = 2 then 'rallies' when l_suppkey % 4 = 3 then 'players' else 'shots' end as target_collection,
  case when l_suppkey % 4 = 2 then l_orderkey else l_orderkey * 100000000 + cast(floor(l_extendedprice * 1e2) as bigint) * 8 + l_linenumber end as target_id,
  {_TYPE.format(k='((l_partkey + 1) % 9)')} as new_type, {_HITTER.format(k='((l_suppkey + 1) % 5)')} as new_hitter,
  l_quantity / 1e1 as new_start_s, l_quantity / 1e1 + l_tax * 1e2 - 2e0 as new_end_s,
  l_partkey % 4 <> 0 as verified, l_suppkey % 10 <> 0 as active,
  cast(l_partkey + l_linenumber as bigint) as corrected_at, cast(1 + l_linenumber % 3 as bigint) as revision
from lineitem join orders on l_orderkey = o_orderkey where l_orderkey % 11 = 0
"""

# Calibrated person detections: box bottoms spread over and around the court.
PERSONS = f"""
select {_div('event_id', 400)} as match_id, event_id as detection_id, {_div('event_id % 400', 4)} as frame,
  {_div('event_id % 400', 4)} / 30e0 as t_s, event_id % 4 as r,
  4e2 + 260e0 * (event_id % 4) + 40e0 * sin({_div('event_id % 400', 4)} / 12e0) + value / 9e0 as l,
  150e0 + 130e0 * (event_id % 4) + value / 7e0 as t,
  4e2 + 260e0 * (event_id % 4) + 40e0 * sin({_div('event_id % 400', 4)} / 12e0) + value / 9e0 + 90e0 as r_px,
  150e0 + 130e0 * (event_id % 4) + value / 7e0 + 260e0 + {_K} * 3e0 as b,
  3e-1 + {_K} / 143e0 as confidence, event_id % 4 + 10 * {_div('event_id % 400', 160)} as tracker_id
from events
"""

VECTORS = "select vec_id, embedding, label from embeddings"

DATASET_FRAMES = """
select d.doc_id as record_id, d.source as source_id, d.lang as clip_id, d.n_chars as n_chars,
  case d.doc_id % 4 when 0 then 'clear_ball' when 1 then 'blurred_ball' when 2 then 'no_ball' else 'hard_negative' end as label_group,
  (d.doc_id % 50) * 2e0 as clip_start_s, (d.doc_id % 50) * 2e0 + 1e0 + (d.n_chars % 40) / 1e1 as clip_end_s,
  l.quality as quality, l.toxic as toxic
from documents d left join labels l on d.doc_id = l.doc_id
"""

TITLES = """
select page_id as match_id,
  case page_id % 8 when 0 then 'AnaBo vs CyDee' when 1 then 'Ana & Bo vs. Cy & Dee 2024-05-01'
    when 2 then 'Ana/Bo versus Cy/Dee' when 3 then 'Ana vs Bo' when 4 then 'Ana + Bo vs Ana + Dee'
    when 5 then 'club final' when 6 then 'Ana and Bo v Cy and Dee - 05/01/2024' else 'AnaBoCy vs DeeEd' end as title
from pages
"""

# Ball detections: the ball itself and, now and then, a distractor beside it.
CANDIDATES = f"""
select match_id, frame, t_s, frame * 10 as detection_id, x_px, y_px, confidence, 1e0 as relevance from fx_ball where status = 'OBSERVED'
union all
select match_id, frame, t_s, frame * 10 + 1, x_px + 300e0, y_px - 80e0, 9e-1, 55e-2 from fx_ball where status = 'OBSERVED' and k % 3 = 0
"""

# Activity bursts of a match, some close together.
BURSTS = """
select o_custkey as match_id, o_orderkey as candidate_no, o_orderkey % 3000 as start_frame,
  o_orderkey % 3000 + 20 + o_orderkey % 57 as end_frame, o_totalprice / 497e3 as quality, (o_orderkey % 83) / 83e0 as confidence
from orders
"""

# Predicted events with a visual and a fused score, to be compared with the truth.
PREDICTED = f"""
select {_div('event_id', 1000)} as match_id, event_id as event_id, event_id % 1000 as frame, (event_id % 1000) / 30e0 as t_s,
  6e-1 + k / 257e0 as visual, least(1e0, 6e-1 + k / 257e0 + (k % 7) / 50e0) as fused,
  {_HITTER.format(k='(k % 5)')} as player_id, {_TYPE.format(k='((k + event_id) % 9)')} as shot_type,
  case when k % 3 = 0 then 'near_side' when k % 3 = 1 then 'far_side' else null end as true_side
from (select *, {_K} as k from events) e where event_id % 6 = 1
"""

TABLES = {
    "fx_predicted": (PREDICTED, ("events",)),
    "fx_bursts": (BURSTS, ("orders",)),
    "fx_candidates": (CANDIDATES, ("fx_ball",)),
    "fx_raw_positions": (RAW_POSITIONS, ("events",)),
    "fx_rallies": (RALLIES, ("events",)),
    "fx_star_rallies": (STAR_RALLIES, ("orders",)),
    "fx_shots": (SHOTS, ("lineitem", "orders")),
    "fx_ball": (BALL, ("events",)),
    "fx_audio": (AUDIO, ("events",)),
    "fx_truth": (TRUTH, ("events",)),
    "fx_boxes": (BOXES, ("lineitem",)),
    "fx_truth_boxes": (TRUTH_BOXES, ("lineitem",)),
    "fx_player_boxes": (PLAYER_BOXES, ("events",)),
    "fx_annotations": (ANNOTATIONS, ("conversations",)),
    "fx_corrections": (CORRECTIONS, ("lineitem", "orders")),
    "fx_persons": (PERSONS, ("events",)),
    "fx_vectors": (VECTORS, ("embeddings",)),
    "fx_dataset_frames": (DATASET_FRAMES, ("documents", "labels")),
    "fx_titles": (TITLES, ("pages",)),
}


class Tables:
    """Reads driver tables and derives fixture tables for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        key = f"fx_{name}"
        if key not in TABLES:
            raise AttributeError(name)
        text, sources = TABLES[key]
        for source in sources:
            text = _mark(text, source)
        return self.spark.sql(text, **{s: getattr(self, s[3:]) if s.startswith("fx_") else self.read(s) for s in sources})


def _mark(text: str, source: str) -> str:
    for word in ("from", "join"):
        text = text.replace(f"{word} {source}", f"{word} {{{source}}}")
    return text
