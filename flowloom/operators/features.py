"""Flow statistics: one hash aggregation over segmented packets.

Segmentation leaves every order-dependent value on the packet row, so the aggregation is a plain
``groupBy`` whose partial step runs before the exchange: only one row per flow and task is shuffled, also
for a flow that holds a third of the packets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.packets import FLAG_BITS, KEY, TCP, UDP
from flowloom.operators.segment import FLOW_TIMEOUT, IDLE_THRESHOLD, segment
from flowloom.schema import RECORD_FIELDS

# Squares are summed in two BIGINT parts: they cannot overflow and stay in generated code.
_SPLIT = 24
_TOP = f"cast({1 << _SPLIT} as decimal(38,0))"
_NONE = "cast(0 as decimal(38,0))"


def _series(name: str, value: str, present: str, low: str) -> dict[str, str]:
    """Partial sums of a packet value: count, sum, split square sum, largest, zero-is-unset minimum."""
    held = f"if({present}, cast({value} as bigint), null)"
    return {
        f"{name}_n": f"count({held})", f"{name}_s": f"coalesce(sum({held}), 0L)",
        f"{name}_qh": f"coalesce(sum(shiftright({held} * {held}, {_SPLIT})), 0L)",
        f"{name}_ql": f"coalesce(sum(({held} * {held}) & {(1 << _SPLIT) - 1}L), 0L)",
        f"{name}_max": f"coalesce(max({held}), 0L)",
        f"{name}_min": f"coalesce(max_by({low}, if({present}, num, null)), 0L)",
    }


def _wide_series(name: str, value: str) -> dict[str, str]:
    """The same for burst spans and idle gaps, which are rare but may exceed 50 minutes."""
    wide = f"cast({value} as decimal(19,0))"
    return {
        f"{name}_n": f"count({value})", f"{name}_s": f"coalesce(sum({value}), 0L)",
        f"{name}_q": f"coalesce(sum(cast({wide} * {wide} as decimal(38,0))), {_NONE})",
        f"{name}_max": f"coalesce(max({value}), 0L)", f"{name}_low": f"coalesce(min({value}), 0L)",
    }


def _mean(total: str, count: str, empty: int = 0) -> str:
    return f"coalesce({total} div nullif({count}, 0L), {empty}L)"


def _square_sum(name: str) -> str:
    return f"cast(cast({name}_qh as decimal(19,0)) * {_TOP} + {name}_ql as decimal(38,0))"


def _once(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """``rows`` with more columns, computed in a step of their own: merged into one, the steps of ``finish_flows`` copy each
    other's expressions and make a method that is too long to be compiled."""
    return rows.select("*", F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in values.items()]))))


def _with_stddevs(rows: DataFrame, series: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Truncated sample deviations with floored integer quotients; 0 for fewer than two values.

    ``series`` has the square sum (DECIMAL), total and count (BIGINT) of each. Quotients are taken in DECIMAL(38,0) after
    removing the remainder, which is exact; ``div`` on wide decimals would be cut to 64 bits.
    """
    wide = "decimal(38,0)"

    def number(count: str) -> str:
        return f"cast({count} as decimal(19,0))"

    rows = _once(rows, {f"_{name}_of_sum": f"cast({number(total)} * {number(total)} as {wide})"
                        for name, (_, total, _) in series.items()})
    rest = {}
    for name, (squares, _, count) in series.items():
        square, n = f"_{name}_of_sum", f"nullif({number(count)}, 0)"
        rest[f"_{name}_rest"] = f"{squares} - cast(({square} - {square} % {n}) / {n} as {wide})"
    rows = _once(rows, rest)
    out = {}
    for name, (_, _, count) in series.items():
        left, less = f"_{name}_rest", f"({number(count)} - 1)"
        variance = f"cast(({left} - {left} % {less}) / {less} as {wide})"
        out[name] = f"if({count} > 1, cast(floor(sqrt(cast({variance} as double))) as bigint), 0L)"
    return _once(rows, out)


def flow_statistics(segmented: DataFrame, within: Sequence[str] = (),
                    idle: int = IDLE_THRESHOLD) -> DataFrame:
    """Flow records from ``segment`` output: 45 fields, plus ``flow_start``, ``start_us``, ``last_us``,
    ``status`` (closed, timed_out, open), ``is_valid`` and ``bursts``."""
    return finish_flows(sum_flows(segmented, within, idle), within)


def sum_flows(segmented: DataFrame, within: Sequence[str] = (), idle: int = IDLE_THRESHOLD) -> DataFrame:
    """Sums, extremes and counts of each flow: what ``finish_flows`` needs."""
    packet, header = "not expires", "cast(iphlen + prhlen as bigint)"
    sums = {
        "start_us": "min(if(not expires, ts_us, null))", "last_us": "max(if(not expires, ts_us, null))",
        "last_burst": "max(burst)", "low_burst": "max_by(low_span, if(not expires, num, null))",
        "closed": "max(closes)", "expired": "max(expires)",
        "tcp_valid": f"max({packet} and client_ready and len > {header})",
        "has_data": f"max({packet} and len > 8)",
        "first_dscp": f"max(if({packet} and num = flow_start, dscp, null))",
        "back_dscp": f"min_by(dscp, if({packet} and side <> front and iat is null and dscp <> 0, num, null))",
        **_wide_series("span", "span"), **_wide_series("idle", f"if(gap > {idle}L, gap, null)"),
    }
    for d, going in (("f", f"({packet} and side = front)"), ("b", f"({packet} and side <> front)")):
        tcp = f"{going} and proto = {TCP}"
        sums |= _series(f"{d}pktl", "len", going, "low_len")
        sums |= _series(f"{d}iat", "iat", f"({going} and iat is not null)", "low_iat")
        sums |= {
            f"total_{d}hlen": f"coalesce(sum(if({going}, {header}, null)), 0L)",
            f"{d}psh_cnt": f"count_if({tcp} and flags & {FLAG_BITS['psh']} <> 0)",
            f"{d}urg_cnt": f"count_if({tcp} and flags & {FLAG_BITS['urg']} <> 0)",
        }
    return segmented.groupBy(*within, *KEY, "flow_start", "front").agg(
        *[F.expr(e).alias(n) for n, e in sums.items()])


def finish_flows(grouped: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Flow records from their sums, row by row; works on streams too."""
    # the last burst ends with the flow
    flows = _once(grouped, {
        "final": "last_us - last_burst", "bursts": "span_n + 1", "active_s": "span_s + last_us - last_burst",
        "active_q": """cast(span_q + cast(last_us - last_burst as decimal(19,0)) * cast(last_us - last_burst as decimal(19,0))
           as decimal(38,0))"""})
    flows = _with_stddevs(flows, {
        "std_active": ("active_q", "active_s", "bursts"), "std_idle": ("idle_q", "idle_s", "idle_n"),
        **{f"std_{d}{v}": (_square_sum(f"{d}{v}"), f"{d}{v}_s", f"{d}{v}_n") for d in "fb" for v in ("pktl", "iat")}})
    out = {
        "srcip": "if(front = 1, ip_b, ip_a)", "srcport": "if(front = 1, port_b, port_a)",
        "dstip": "if(front = 1, ip_a, ip_b)", "dstport": "if(front = 1, port_a, port_b)",
        "duration": "last_us - start_us",
        "min_active": "if(coalesce(low_burst, 0L) = 0 or final < low_burst, final, low_burst)",
        "mean_active": _mean("active_s", "bursts"), "max_active": "greatest(span_max, final)",
        "min_idle": "idle_low", "mean_idle": _mean("idle_s", "idle_n"), "max_idle": "idle_max",
        "dscp": "cast(if(first_dscp <> 0, first_dscp, coalesce(back_dscp, 0)) as int)",
        "status": "case when closed then 'closed' when expired then 'timed_out' else 'open' end",
        "is_valid": f"if(proto = {UDP}, has_data and bpktl_n > 0, tcp_valid)",
    }
    for d, empty in (("f", 0), ("b", -1)):
        n, s = f"{d}pktl_n", f"{d}pktl_s"
        out |= {
            f"total_{d}packets": n, f"total_{d}volume": s,
            f"min_{d}pktl": f"{d}pktl_min", f"mean_{d}pktl": _mean(s, n, empty), f"max_{d}pktl": f"{d}pktl_max",
            f"min_{d}iat": f"{d}iat_min", f"mean_{d}iat": _mean(f"{d}iat_s", f"{d}iat_n"),
            f"max_{d}iat": f"{d}iat_max",
            f"sflow_{d}packets": f"{n} div bursts", f"sflow_{d}bytes": f"{s} div bursts",
        }
    wanted = [*RECORD_FIELDS, "flow_start", "start_us", "last_us", "bursts", "status", "is_valid"]
    return flows.selectExpr(*within, *[f"{out.get(n, n)} as {n}" for n in wanted])


def emit(flows: DataFrame, policy: str = "all") -> DataFrame:
    """Which flows leave the meter: ``all``, ``open`` (what is still open at the end of a capture) or
    ``valid``."""
    if policy == "all":
        return flows
    if policy == "open":
        return flows.filter(F.col("status") == "open")
    if policy == "valid":
        return flows.filter("is_valid")
    raise ValueError(f"unknown emission policy {policy!r}")


def expire_idle(flows: DataFrame, now_us: int | Column, timeout: int = FLOW_TIMEOUT) -> DataFrame:
    """Open flows that have been silent for longer than the timeout at ``now_us``."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    return flows.filter((F.col("status") == "open") & (now - F.col("last_us") > timeout))


def capture_windows(packets: DataFrame, seconds: int = 2) -> DataFrame:
    """Add ``capture_window``: the number of the capture interval, for ``within``."""
    return packets.withColumn("capture_window", F.call_function("div", F.col("ts_us"), F.lit(seconds * 1_000_000)))


def flow_records(packets: DataFrame, within: Sequence[str] = (), policy: str = "all",
                 timeout: int = FLOW_TIMEOUT, idle: int = IDLE_THRESHOLD, **segmenting) -> DataFrame:
    """Packets to flow records; see ``segment`` and ``flow_statistics``."""
    rows = segment(packets, within, timeout, idle, **segmenting)
    return emit(flow_statistics(rows, within, idle), policy)
