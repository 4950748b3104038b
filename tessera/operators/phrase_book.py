"""A user's key phrases in memory, as interests learn them, their relevances change, and phrases are shown and come back.

A phrase stands under a relevance, its own (from the selection) or its interest's (from the last showing). An interest
knows which relevances it stands for; phrases under others are *stale*: they stay, with the relevance they had, may still
be shown, and aren't touched by what happens to their interest. A phrase becomes stale when another one that stands under
the same relevance is shown, as the showing makes the interest forget the relevance. With ``keep_stale`` off interests
never forget, and leftovers always carry the present relevance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np

from .interests import Config
from .keyphrase import select_phrases, unify

HELD, STALE, SHOWN = "held", "stale", "shown"


@dataclass
class Phrase:
    coi_id: str
    words: str
    point: np.ndarray
    #: Whether the relevance is the phrase's own or its interest's.
    own: bool
    relevance: float
    standing: str = HELD

    @property
    def shelf(self) -> tuple[bool, float, str]:
        """Phrases of one shelf stand under one relevance; an interest's come before a phrase's own, then the least first."""
        return self.own, self.relevance, self.coi_id


@dataclass
class PhraseBook:
    """phrases: all of a user, those of a shelf in their order, shown ones in the order in which they were shown."""

    phrases: list[Phrase] = field(default_factory=list)
    keep_stale: bool = True

    def _standing(self, coi_id: str, *standings: str) -> list[Phrase]:
        return [p for p in self.phrases if p.coi_id == coi_id and p.standing in standings]

    def _drop(self, gone: Iterable[Phrase]) -> None:
        ids = {id(p) for p in gone}
        self.phrases = [p for p in self.phrases if id(p) not in ids]

    def _settle(self, coi_id: str, knows: set[tuple[bool, float]]) -> None:
        """The interest knows just these relevances."""
        for p in self._standing(coi_id, HELD, STALE):
            p.standing = HELD if (p.own, p.relevance) in knows or not self.keep_stale else STALE

    def _known(self, coi_id: str) -> set[tuple[bool, float]]:
        return {(p.own, p.relevance) for p in self._standing(coi_id, HELD)}

    def put(self, phrase: Phrase) -> None:
        """Add a phrase; its interest then knows its relevance, next to others only if all of them are phrases' own."""
        before = {k for k in self._known(phrase.coi_id) if k[0]} if phrase.own else set()
        phrase.standing = HELD
        self.phrases.append(phrase)
        self._settle(phrase.coi_id, before | {(phrase.own, phrase.relevance)})

    def take_away(self, coi_id: str) -> dict[str, np.ndarray]:
        """Remove an interest's phrases, those that were shown too, but for stale ones; the removed live ones by words."""
        live = self._standing(coi_id, HELD)
        self._drop([*live, *self._standing(coi_id, SHOWN)])
        return {p.words: p.point for p in live}

    def learn(self, coi_id: str, at: np.ndarray, candidates: Iterable[str], encode: Callable[[str], np.ndarray], config: Config) -> None:
        """Of the interest's phrases and the candidates the best ones are kept, with relevances of their own."""
        both = unify(self.take_away(coi_id), sorted(set(candidates)), encode)
        for words, relevance in select_phrases(both, at, config.max_key_phrases, config.gamma):
            self.put(Phrase(coi_id, words, both[words], True, relevance))

    def reprice(self, relevances: Mapping[str, float]) -> None:
        """Interests' phrases go to their interest's present relevance, those with the least before first."""
        for coi_id, relevance in relevances.items():
            moved = sorted(self._standing(coi_id, HELD), key=lambda p: p.relevance if p.own else 0.0)
            self._drop(moved)
            for p in moved:
                p.own, p.relevance = False, relevance
            self.phrases += moved
            self._settle(coi_id, {(False, relevance)})

    def refill(self) -> None:
        """Once all phrases were shown they come back, the last shown first."""
        if any(p.standing != SHOWN for p in self.phrases):
            return
        back, self.phrases = self.phrases[::-1], []
        for p in back:
            self.put(p)

    def show(self, relevances: Mapping[str, float], top: int, penalty: tuple[float, ...]) -> list[tuple[Phrase, float]]:
        """The best phrases of these interests, with their scores; they count as shown from now on.

        From the end of a shelf, phrases have their shelf's relevance times one penalty after the other; beyond the
        penalties they have none. Ties go by shelf.
        """
        self.refill()
        self.reprice(relevances)
        shelves: dict[tuple, list[Phrase]] = {}
        for p in self.phrases:
            if p.standing != SHOWN and p.coi_id in relevances:
                shelves.setdefault(p.shelf, []).append(p)
        offered = [(p, p.relevance * weight) for key in sorted(shelves) for weight, p in zip(penalty, reversed(shelves[key]), strict=False)]
        chosen = sorted(offered, key=lambda x: -x[1])[:top]
        for p, _ in chosen:
            self._drop([p])
            if p.standing == HELD:
                left = self._known(p.coi_id) - {(p.own, p.relevance)}
                self._settle(p.coi_id, left)
            p.standing = SHOWN
            self.phrases.append(p)
        return chosen
