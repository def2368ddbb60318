"""Stateful operators of streams. Rows of a key are taken in the order of a sequence column within each micro-batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetrace.functions.text import PhraseBuffer
from kinetrace.sources.audio import resampled_part


def drop_adjacent_repeats(rows: DataFrame, key: str, seq: str, stamp: str) -> DataFrame:
    """``key, seq, stamp`` of rows whose stamp (a double) differs from the one before it, with running ``polls`` and ``repeats``.

    Unlike a distinct, a stamp that comes back later counts as new.
    """
    kind = dict(rows.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, polls, repeats = state.get if state.exists else (None, 0, 0)
        out = []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            polls += 1
            now = getattr(row, stamp)
            if now == last:
                repeats += 1
            else:
                out.append((k[0], getattr(row, seq), now, polls, repeats))
            last = now
        state.update((last, polls, repeats))
        yield pd.DataFrame(out, columns=[key, seq, stamp, "polls", "repeats"])

    held = rows.select(key, seq, F.col(stamp).cast("double").alias(stamp))
    return held.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seq} long, {stamp} double, polls long, repeats long", "last double, polls long, repeats long", "append", GroupStateTimeout.NoTimeout)


def latest_values(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The newest row of each key so far, for update or complete output."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def phrases_of_deltas(rows: DataFrame, key: str, seq: str, delta: str, minimum: int = 10, maximum: int = 52) -> DataFrame:
    """``key, phrase`` as text comes in pieces; a null piece ends a key's text and gives what is left."""
    kind = dict(rows.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, first = state.get if state.exists else ("", True)
        buffer = PhraseBuffer(minimum, maximum, rest=rest, first=first)
        out = []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            piece = getattr(row, delta)
            out += buffer.push(piece) if isinstance(piece, str) else [buffer.flush()]
        state.update((buffer.rest, buffer.first))
        yield pd.DataFrame({key: k[0], "phrase": [p for p in out if p]})

    return rows.select(key, seq, delta).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, phrase string", "rest string, first boolean", "append", GroupStateTimeout.NoTimeout)


def full_blocks(rows: DataFrame, key: str, seq: str, pcm: str, size: int) -> DataFrame:
    """``key, block`` of exactly ``size`` bytes whenever that much has come in; a second end of a key gives nothing.

    A null ``pcm`` ends a key: what is left comes out and later rows are ignored.
    """
    kind = dict(rows.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ended = state.get if state.exists else (b"", False)
        held, out = bytes(held), []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            piece = getattr(row, pcm)
            if ended:
                continue
            if piece is None:
                ended = True
                out += [held] if held else []
                held = b""
                continue
            held += bytes(piece)
            while len(held) >= size:
                out.append(held[:size])
                held = held[size:]
        state.update((held, ended))
        yield pd.DataFrame({key: k[0], "block": out})

    return rows.select(key, seq, pcm).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, block binary", "held binary, ended boolean", "append", GroupStateTimeout.NoTimeout)


def current_only(replies: DataFrame, key: str, seq: str, generation: str) -> DataFrame:
    """``key, seq, generation`` of replies whose generation is not older than the newest seen for their key."""
    kind = dict(replies.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (newest,) = state.get if state.exists else (None,)
        out = []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            now = int(getattr(row, generation))
            if newest is None or now >= newest:
                out.append((k[0], getattr(row, seq), now))
                newest = now
        state.update((newest,))
        yield pd.DataFrame(out, columns=[key, seq, generation])

    return replies.select(key, seq, generation).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seq} long, {generation} long", "newest long", "append", GroupStateTimeout.NoTimeout)


def resampled_stream(rows: DataFrame, key: str, seq: str, samples: str, rate: int, to: int) -> DataFrame:
    """``key, start, pcm`` as blocks of a signal come in: 16-bit samples at the rate ``to``, and the place of the first of them.

    The state is the number of samples so far and the last one of them; places are reckoned in whole numbers, so any cutting into blocks gives the samples of
    one block. A null block ends a signal, and the next one of its key begins anew.
    """
    kind = dict(rows.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, 0.0)
        out = []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            block = getattr(row, samples)
            if block is None:
                seen = 0
            elif len(block):
                own = np.concatenate([[last], block]) if seen else np.asarray(block)
                first, seen, last = max(seen - 1, 0), seen + len(block), float(own[-1])
                start, new = resampled_part(own, first, rate, to, seen)
                if len(new):
                    out.append((k[0], start, new.tobytes()))
        state.update((seen, last))
        yield pd.DataFrame(out, columns=[key, "start", "pcm"])

    held = rows.select(key, seq, F.col(samples).cast("array<float>").alias(samples))
    return held.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start long, pcm binary", "seen long, last double", "append", GroupStateTimeout.NoTimeout)


def trailing_rates(rows: DataFrame, key: str, seq: str, t: str, span: float, most: int) -> DataFrame:
    """``key, seq, rate`` of each arrival: arrivals per unit of ``t``, a double, among the last ``most`` that are at most ``span`` old; 0 for less than two or no time between."""
    kind = dict(rows.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = deque(state.get[0] if state.exists else (), maxlen=most)
        out = []
        for row in pd.concat(parts).sort_values(seq).itertuples(index=False):
            now = float(getattr(row, t))
            ring.append(now)
            recent = [x for x in ring if now - x <= span]
            time = recent[-1] - recent[0]
            out.append((k[0], getattr(row, seq), (len(recent) - 1) / time if time > 0 else 0.0))
        state.update((list(ring),))
        yield pd.DataFrame(out, columns=[key, seq, "rate"])

    held = rows.select(key, seq, F.col(t).cast("double").alias(t))
    return held.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {seq} long, rate double", "ring array<double>", "append", GroupStateTimeout.NoTimeout)
