"""Time series operators on rows trace_id, n (0, 1, 2, ... in a trace), x."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.node import Transform
from ..plans.ordered import ranks

#: samples to a window partition; a frame that reaches beyond it is served by copied samples
CHUNK = 1 << 16


class Signal(Transform):
    def __init__(self, trace: str = "trace_id", n: str = "n", x: str = "x", **kw):
        super().__init__(**kw)
        self.trace, self.n, self.x = trace, n, x

    def framed(self, df: DataFrame, before: int, after: int, value: Callable) -> DataFrame:
        """x := value(window) where the window orders a trace and reaches ``before`` back and ``after`` ahead.

        A trace is cut in chunks; samples near a border are copied to the
        neighbour's partition (``before`` + ``after`` of CHUNK), so a single
        long trace is spread over many tasks.
        """
        n, size = F.col(self.n), max(CHUNK, before + after)
        own = F.floor(n / size)
        near = F.array_distinct(F.array(own, F.floor((n + before) / size), F.floor((n - after) / size)))
        spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(near))
        w = Window.partitionBy(self.trace, "_chunk").orderBy(self.n)
        return spread.withColumn(self.x, value(w)).where("_chunk = _own").drop("_chunk", "_own")

    def joined(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df with aggregates of its trace: map-side combined, then joined; traces are few against samples."""
        per_trace = df.groupBy(F.col(self.trace).alias("_t")).agg(*[a.alias(k) for k, a in aggregates.items()])
        return df.join(per_trace, F.col(self.trace).eqNullSafe(F.col("_t"))).drop("_t")


class Numbered(Signal):
    """Numbers samples from 0 in each trace by an order (in two steps, see plans.ordered)."""

    def __init__(self, order: list[str], **kw):
        super().__init__(**kw)
        self.order = order

    def apply(self, df):
        return ranks(df, [self.trace], self.order, self.n).withColumn(self.n, F.col(self.n) - 1)


class MeanNorm(Signal):
    """x / (sum of |x| over the 2N samples from n-N to n+N-1, clipped at the ends, / (2N+1))."""

    def __init__(self, window: int, **kw):
        super().__init__(**kw)
        self.window = window

    def apply(self, df):
        k, x = self.window, F.col(self.x)
        return self.framed(df, k, k - 1, lambda w: F.try_divide(x, F.sum(F.abs(x)).over(w.rowsBetween(-k, k - 1)) / (2 * k + 1)))


class OneBit(Signal):
    """The sign."""

    def apply(self, df):
        return df.withColumn(self.x, F.signum(self.x))


class GainNorm(Signal):
    """x * rms / (rms^2 + 1e-12 * max rms), rms over a triangular window of floor(seconds / dt + 1/2) samples a side."""

    def __init__(self, seconds: float, dt: float, **kw):
        super().__init__(**kw)
        self.half = int(seconds / dt + 0.5)

    def apply(self, df):
        half, x = self.half, F.col(self.x)

        def power(w):
            total = x * x
            for j in range(1, half + 1):
                weight = 1.0 - j / (half + 1.0)
                total = total + F.lit(weight) * (F.coalesce(F.lag(x * x, j).over(w), F.lit(0.0)) + F.coalesce(F.lead(x * x, j).over(w), F.lit(0.0)))
            return F.struct(x.alias("x"), F.sqrt(total).alias("rms"))

        df = self.framed(df, half, half, power)
        most = self.joined(df.withColumn("_rms", F.col(f"{self.x}.rms")), _most=F.max("_rms"))
        rms = F.col("_rms")
        return most.withColumn(self.x, F.try_divide(F.col(f"{self.x}.x") * rms, rms * rms + F.lit(1e-12) * F.col("_most"))).drop("_rms", "_most")


class Demean(Signal):
    """x less the trace's mean."""

    def apply(self, df):
        return self.joined(df, _m=F.avg(self.x)).withColumn(self.x, F.col(self.x) - F.col("_m")).drop("_m")


class DetrendSimple(Signal):
    """x less the line through the trace's first and last sample."""

    def apply(self, df):
        n, x = F.col(self.n), F.col(self.x)
        ends = self.joined(df, _a=F.min(F.struct(n.alias("n"), x.alias("x"))), _b=F.max(F.struct(n.alias("n"), x.alias("x"))))
        slope = F.coalesce(F.try_divide(F.col("_b.x") - F.col("_a.x"), F.col("_b.n") - F.col("_a.n")), F.lit(0.0))
        return ends.withColumn(self.x, x - F.col("_a.x") - slope * (n - F.col("_a.n"))).drop("_a", "_b")


class DetrendLinear(Signal):
    """x less the least-squares line of the trace."""

    def apply(self, df):
        n, x = F.col(self.n), F.col(self.x)
        fit = self.joined(df, _s=F.regr_slope(x, n), _i=F.regr_intercept(x, n), _m=F.avg(x))
        return fit.withColumn(self.x, x - F.coalesce(F.col("_i") + F.col("_s") * n, F.col("_m"))).drop("_s", "_i", "_m")


class Decimate(Signal):
    """Every k-th sample, renumbered; no filter against aliasing (put a Bandpass before it)."""

    def __init__(self, factor: int, **kw):
        super().__init__(**kw)
        self.factor = factor

    def apply(self, df):
        return df.where(F.col(self.n) % self.factor == 0).withColumn(self.n, (F.col(self.n) / self.factor).cast("bigint"))


class PerTrace(Signal):
    """x := function(samples of the whole trace in order, as numpy). The transform needs the whole trace in one task."""

    costly = True

    def __init__(self, function: Callable, **kw):
        super().__init__(**kw)
        self.function = function

    def apply(self, df):
        function, n, x = self.function, self.n, self.x

        def run(part):
            part = part.sort_values(n)
            part[x] = function(part[x].to_numpy(dtype=float))
            return part

        return df.groupBy(self.trace).applyInPandas(run, df.schema)


def whiten(x):
    """The signal with all spectral amplitudes 1: zero-padded to a power of two, cut back to its length."""
    import numpy as np

    size = 1 << max(0, int(len(x) - 1).bit_length())
    spectrum = np.fft.fft(x, size)
    amplitude = np.abs(spectrum)
    return np.real(np.fft.ifft(np.divide(spectrum, amplitude, out=np.zeros_like(spectrum), where=amplitude > 0)))[: len(x)]


def Whiten(**kw) -> PerTrace:
    return PerTrace(whiten, **kw)


#: whitening with smoothed amplitudes: the smoothing is the identity
WhitenSmooth = Whiten


def bandpass(low: float, high: float, rate: float, corners: int = 4):
    """A zero-phase Butterworth response of ``corners`` corners, applied to the spectrum."""

    def run(x):
        import numpy as np

        f = np.fft.rfftfreq(len(x), 1.0 / rate) if len(x) else np.zeros(0)
        with np.errstate(divide="ignore"):
            up = 1.0 / np.sqrt(1.0 + np.where(f > 0, (low / np.maximum(f, 1e-300)) ** (2 * corners), np.inf))
        down = 1.0 / np.sqrt(1.0 + (f / high) ** (2 * corners))
        return np.fft.irfft(np.fft.rfft(x) * up * down, len(x)) if len(x) else x

    return run


def Bandpass(low: float, high: float, rate: float, corners: int = 4, **kw) -> PerTrace:
    return PerTrace(bandpass(low, high, rate, corners), **kw)
