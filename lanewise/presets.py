"""Constants of the operators.

Two families: fixed values of the court-and-notation domain (metres, frames,
seconds), and TRACK, the same rules re-expressed for the `events` table, whose
clock is milliseconds and where one domain second stands for eight hours.
"""

from dataclasses import dataclass

# ---- fixed values: court geometry (metres) ----
COURT_W, COURT_L = 10.97, 23.77
NET_Y = COURT_L / 2
CENTER_X = COURT_W / 2
SINGLES_MARGIN = 1.372
SIDE_L, SIDE_R = SINGLES_MARGIN, COURT_W - SINGLES_MARGIN

# ---- fixed values: view gate ----
INTERIOR_MIN, LINE_MIN = 0.80, 0.35

# ---- fixed values: box hygiene ----
JUMP_M = 2.5
REACH_SHARE, REACH_SLACK = 0.6, 30.0

# ---- fixed values: votes of the alternation search ----
VOTE_TOUCH, VOTE_SERVE, VOTE_LANDING, FLIP_COST, FLIP_SLOTS = 3.0, 2.0, 1.0, 0.75, 4

# ---- fixed values: quality of each rung of the signal ladder ----
LADDER_QUALITY = {"land_near": 0.86, "contact": 0.77, "cross": 0.67, "land_far": 0.47, "none": 0.0}

# ---- fixed values: triage ----
PRECISION_TARGET, MIN_FLAGS, GOOD_EDITS = 0.90, 5, 5
TRUST_MIN, VERIFY_MIN = 0.80, 0.45

# ---- fixed values: alphabets of the notation ----
FOREHAND, BACKHAND, NEUTRAL = "frvoul", "bszpym", "hijkt"
SHOTS = FOREHAND + BACKHAND + NEUTRAL          # strokes the tokeniser knows
SHOT_LETTERS = SHOTS + "q"                     # q (unknown stroke) is legal, not tokenised
SERVE_DIGITS, DIRECTIONS, DEPTHS = "0456", "0123", "789"
ERROR_LETTERS, ENDING_MARKS, FAULT_LETTERS = "nwdx!e", "*@#", "nwdxg!e"
OTHER_MARKS = "+-=;^c"

# ---- fixed values: legal point scores and the repair of misread ones ----
POINT_SCORES = ["0", "15", "30", "40", "AD"]
SCORE_REPAIR = {
    "25": "15", "26": "15", "20": "15", "6": "15", "5": "15", "1": "15", "150": "15",
    "10": "40", "35": "30", "320": "30", "300": "30", "3": "30",
    "45": "40", "400": "40", "48": "40", "4": "40", "00": "0",
}

HOUR = 3_600_000
DAY = 24 * HOUR


@dataclass(frozen=True)
class Track:
    """The domain rules on the clock of the `events` table (milliseconds)."""

    second: int = 8 * HOUR
    frame: int = 8 * HOUR // 30
    slice_rows: int = 500_000       # rows of one entity given to one task
    slice_ms: int = 10 * DAY        # widest stretch of an entity's derived rows (chains, runs) given to one task
    hole: int = 12 * HOUR           # gap between samples that counts as a hole
    dead_gap: int = 24 * HOUR       # 3 s
    long_gap: int = 16 * HOUR       # 2 s
    recv: int = 9 * HOUR + HOUR * 6 // 10   # 1.2 s
    launch_back: int = 4 * HOUR     # .5 s
    launch_fwd: int = 8 * HOUR // 5         # .2 s
    min_gap: int = 8 * HOUR * 8 // 30       # 8 frames of 30
    reach: int = 8 * HOUR * 14 // 30        # 14 frames of 30
    settle: int = 8 * HOUR
    settle_step: int = 2 * HOUR
    merge_gap: int = 8 * HOUR * 6 // 10
    min_run: int = 24 * HOUR
    present_share: float = 0.30     # a segment in which fewer rows are present is no segment
    absent_close: int = 120 * HOUR  # 15 s
    cross_gap: int = 24 * HOUR
    cross_span_min: float = 5.0
    cross_span_max: float = 40.0
    cross_speed_min: float = 0.5    # metres per domain second
    cross_speed_max: float = 90.0
    cross_samples: int = 4
    cross_samples_weak: int = 3
    cross_max_step: float = 6.0     # metres per frame


TRACK = Track()


def check_grammar() -> None:
    """Every alphabet is disjoint where the tokeniser needs it to be."""
    assert not set(SHOTS) & set(DIRECTIONS + DEPTHS + ENDING_MARKS)
    assert len(set(SHOTS)) == len(SHOTS)
