"""Score replay: pure transitions on one tuple of counters.

A pair is won at a goal with two ahead; points win games and games win sets by that one rule. Who serves and
whether a tiebreak runs follow from the counters.
"""

from typing import NamedTuple

#: Points that win a game of each kind.
GOALS = {"game": 4, "tb7": 7, "tb10": 10}
GAMES_TO_WIN, TIEBREAK_AT = 6, (6, 6)
CALLS = ("0", "15", "30", "40")


class Count(NamedTuple):
    """Sets, games, points of either player; number of the game and who opened it."""
    s1: int = 0
    s2: int = 0
    g1: int = 0
    g2: int = 0
    p1: int = 0
    p2: int = 0
    game_no: int = 1
    opener: int = 1


def _won(a: int, b: int, goal: int) -> bool:
    return max(a, b) >= goal and abs(a - b) >= 2


def _plus(a: int, b: int, who: int) -> tuple[int, int]:
    return a + (who == 1), b + (who == 2)


class Rules:
    """final_set: 'tb7', 'tb10' or 'adv' (no tiebreak) in the last possible set."""

    def __init__(self, best_of: int = 3, final_set: str = "tb7"):
        self.best_of, self.final_set = best_of, final_set

    def over(self, c: Count) -> bool:
        return max(c.s1, c.s2) > self.best_of // 2

    def ending(self, c: Count) -> str:
        """How the current set ends at six all."""
        last = c.s1 + c.s2 + (not self.over(c)) == self.best_of
        return self.final_set if last else "tb7"

    def kind(self, c: Count) -> str:
        ending = self.ending(c)
        return "game" if ending == "adv" or (c.g1, c.g2) != TIEBREAK_AT else ending

    def server(self, c: Count) -> int:
        """Serves change after the first point of a tiebreak and then after every second."""
        turns = 0 if self.kind(c) == "game" else (c.p1 + c.p2 + 1) // 2
        return c.opener if turns % 2 == 0 else 3 - c.opener

    def call(self, c: Count) -> str:
        """The points, the server's first."""
        a, b = (c.p1, c.p2) if self.server(c) == 1 else (c.p2, c.p1)
        if self.kind(c) != "game":
            return f"{a}-{b}"
        if min(a, b) < 3:
            return f"{CALLS[min(a, 3)]}-{CALLS[min(b, 3)]}"
        return {0: "40-40", 1: "AD-40", -1: "40-AD"}[(a > b) - (a < b)]

    def context(self, c: Count) -> tuple:
        return (c.s1, c.s2, c.g1, c.g2, self.call(c), c.game_no, self.ending(c) != "adv", self.server(c))

    def after(self, c: Count, winner: int) -> Count:
        """The counters after a point. A match that is over plays on in its last set."""
        p1, p2 = _plus(c.p1, c.p2, winner)
        kind = self.kind(c)
        if not _won(p1, p2, GOALS[kind]):
            return c._replace(p1=p1, p2=p2)
        g1, g2 = _plus(c.g1, c.g2, winner)
        c = c._replace(g1=g1, g2=g2, p1=0, p2=0, game_no=c.game_no + 1, opener=3 - c.opener)
        if kind == "game" and not _won(g1, g2, GAMES_TO_WIN):
            return c
        s1, s2 = _plus(c.s1, c.s2, winner)
        c = c._replace(s1=s1, s2=s2)
        return c if self.over(c) else c._replace(g1=0, g2=0)
