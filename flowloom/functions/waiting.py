"""Packets of one key that wait until no earlier one can come any more.

Packets may come in any order, but have to be taken by arrival number. A clock that runs back by at most ``skew`` from one
number to the next higher one means: once the watermark is ``skew`` past a packet's time, every packet with a smaller
number is there. Packets wait in slices of packet time, so what is in memory at once is two slices, however long a key has
to wait or however many of its packets come in one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator


def due_ms(number: int, width: int, skew: int) -> int:
    """Watermark from which slice ``number`` (``width`` microseconds long) may go on."""
    return ((number + 1) * width + skew) // 1000 + 1


def released(numbers: list[int], ready: set[int], take: Callable[[int], list[dict]], width: int,
             ) -> Iterator[tuple[list[dict], dict[int, list[dict]]]]:
    """The packets of the ``ready`` slices in order of ``num``, one slice at a time, and what is held back meanwhile.

    ``numbers`` are all waiting slices. Packets of the next slice that have smaller numbers than some of this one go
    with it; ``take`` hands out a slice's packets and forgets them, so after each step those held back are to be kept.
    """
    held: dict[int, list[dict]] = {}
    waiting = set(numbers)

    def load(number: int) -> list[dict]:
        if number in held:
            return held[number]
        if number in waiting:
            waiting.discard(number)
            held[number] = take(number)
            return held[number]
        return []

    for number in sorted(ready):
        now = load(number)
        top = max((p["num"] for p in now), default=-1)
        after = load(number + 1)
        out = sorted(now + [p for p in after if p["num"] <= top], key=lambda p: p["num"])
        held.pop(number, None)
        if after:
            held[number + 1] = [p for p in after if p["num"] > top]
        yield out, held
