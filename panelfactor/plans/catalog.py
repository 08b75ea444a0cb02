"""The 518 catalogued factors: Alpha158 (9 candle shapes, 4 price ratios, 29 rolling features) and Alpha360."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Factor:
    """A named factor; verification is `transcribed` for published expressions and `transformed` for those under another name."""

    id: str
    family: str
    name: str
    expression: str
    description: str = ""
    source: str = ""
    verification: str = "transcribed"


# The published expressions of the Alpha158 and Alpha360 factor sets
CANDLES = {
    "KMID": "($close-$open)/$open",
    "KLEN": "($high-$low)/$open",
    "KMID2": "($close-$open)/($high-$low+1e-12)",
    "KUP": "($high-Greater($open,$close))/$open",
    "KUP2": "($high-Greater($open,$close))/($high-$low+1e-12)",
    "KLOW": "(Less($open,$close)-$low)/$open",
    "KLOW2": "(Less($open,$close)-$low)/($high-$low+1e-12)",
    "KSFT": "(2*$close-$high-$low)/$open",
    "KSFT2": "(2*$close-$high-$low)/($high-$low+1e-12)",
}
PRICES = {"OPEN": "$open/$close", "HIGH": "$high/$close", "LOW": "$low/$close", "VWAP": "$vwap/$close"}
ROLLING = {
    "ROC": "Ref($close,{n})/$close",
    "MA": "Mean($close,{n})/$close",
    "STD": "Std($close,{n})/$close",
    "BETA": "Slope($close,{n})/$close",
    "RSQR": "Rsquare($close,{n})",
    "RESI": "Resi($close,{n})/$close",
    "MAX": "Max($high,{n})/$close",
    "MIN": "Min($low,{n})/$close",
    "QTLU": "Quantile($close,{n},0.8)/$close",
    "QTLD": "Quantile($close,{n},0.2)/$close",
    "RANK": "Rank($close,{n})",
    "RSV": "($close-Min($low,{n}))/(Max($high,{n})-Min($low,{n})+1e-12)",
    "IMAX": "IdxMax($high,{n})/{n}",
    "IMIN": "IdxMin($low,{n})/{n}",
    "IMXD": "(IdxMax($high,{n})-IdxMin($low,{n}))/{n}",
    "CORR": "Corr($close,Log($volume+1),{n})",
    "CORD": "Corr($close/Ref($close,1),Log($volume/Ref($volume,1)+1),{n})",
    "CNTP": "Mean($close>Ref($close,1),{n})",
    "CNTN": "Mean($close<Ref($close,1),{n})",
    "CNTD": "Mean($close>Ref($close,1),{n})-Mean($close<Ref($close,1),{n})",
    "SUMP": "Sum(Greater($close-Ref($close,1),0),{n})/(Sum(Abs($close-Ref($close,1)),{n})+1e-12)",
    "SUMN": "Sum(Greater(Ref($close,1)-$close,0),{n})/(Sum(Abs($close-Ref($close,1)),{n})+1e-12)",
    "SUMD": "(Sum(Greater($close-Ref($close,1),0),{n})-Sum(Greater(Ref($close,1)-$close,0),{n}))/(Sum(Abs($close-Ref($close,1)),{n})+1e-12)",
    "VMA": "Mean($volume,{n})/($volume+1e-12)",
    "VSTD": "Std($volume,{n})/($volume+1e-12)",
    "WVMA": "Std(Abs($close/Ref($close,1)-1)*$volume,{n})/(Mean(Abs($close/Ref($close,1)-1)*$volume,{n})+1e-12)",
    "VSUMP": "Sum(Greater($volume-Ref($volume,1),0),{n})/(Sum(Abs($volume-Ref($volume,1)),{n})+1e-12)",
    "VSUMN": "Sum(Greater(Ref($volume,1)-$volume,0),{n})/(Sum(Abs($volume-Ref($volume,1)),{n})+1e-12)",
    "VSUMD": "(Sum(Greater($volume-Ref($volume,1),0),{n})-Sum(Greater(Ref($volume,1)-$volume,0),{n}))/(Sum(Abs($volume-Ref($volume,1)),{n})+1e-12)",
}
WINDOWS = (5, 10, 20, 30, 60)
LAGGED = ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP", "VOLUME")
LAGS = range(59, -1, -1)


#: what the features tell
MEANING = {
    "KMID": "body of the candle, relative to the open",
    "KLEN": "range of the candle, relative to the open",
    "KMID2": "body of the candle, relative to its range",
    "KUP": "upper shadow, relative to the open",
    "KUP2": "upper shadow, relative to the range",
    "KLOW": "lower shadow, relative to the open",
    "KLOW2": "lower shadow, relative to the range",
    "KSFT": "place of the close between high and low, relative to the open",
    "KSFT2": "place of the close between high and low, relative to the range",
    "ROC": "earlier close over the current one",
    "MA": "mean close",
    "STD": "deviation of the close",
    "BETA": "slope of the close",
    "RSQR": "linearity of the close",
    "RESI": "distance of the close from its trend",
    "MAX": "highest high",
    "MIN": "lowest low",
    "QTLU": "upper quantile of the close",
    "QTLD": "lower quantile of the close",
    "RANK": "rank of the close",
    "RSV": "place of the close between the lowest low and the highest high",
    "IMAX": "time since the window's begin of the highest high",
    "IMIN": "time since the window's begin of the lowest low",
    "IMXD": "time between the lowest low and the highest high",
    "CORR": "correlation of close and log volume",
    "CORD": "correlation of the changes of close and volume",
    "CNTP": "share of rises",
    "CNTN": "share of falls",
    "CNTD": "share of rises less that of falls",
    "SUMP": "rises over all changes",
    "SUMN": "falls over all changes",
    "SUMD": "rises less falls, over all changes",
    "VMA": "mean volume",
    "VSTD": "deviation of the volume",
    "WVMA": "variation of the changes weighted by volume",
    "VSUMP": "rises of the volume over all its changes",
    "VSUMN": "falls of the volume over all its changes",
    "VSUMD": "rises less falls of the volume, over all its changes",
}


def alpha158() -> list[Factor]:
    def one(name: str, text: str, description: str, source: str, verification: str = "transcribed") -> Factor:
        return Factor(f"alpha158-{name.lower()}", "Alpha158", name, text, description, source, verification)

    out = [one(name, text, MEANING[name], name) for name, text in CANDLES.items()]
    out += [one(name, text, f"{name.lower()} over close", f"{name}0", "transformed") for name, text in PRICES.items()]
    return out + [one(f"{name}{n}", text.format(n=n), f"{MEANING[name]}, over {n} rows", f"{name}{n}") for name, text in ROLLING.items() for n in WINDOWS]


def alpha360() -> list[Factor]:
    out = []
    for name in LAGGED:
        own = f"${name.lower()}"
        base = f"({own}+1e-12)" if name == "VOLUME" else "$close"
        for k in LAGS:
            out.append(Factor(f"alpha360-{name.lower()}{k}", "Alpha360", f"{name}{k}", f"Ref({own},{k})/{base}" if k else f"{own}/{base}", f"{name.lower()} of {k} rows before, over {'volume' if name == 'VOLUME' else 'close'}" if k else f"current {name.lower()}, relative to itself or the close", f"{name}{k}"))
    return out


def catalogue() -> list[Factor]:
    return alpha158() + alpha360()


def search(text: str, family: str | None = None) -> list[Factor]:
    """Factors that have all words of a text in their id, name, expression or description."""
    words = text.lower().split()
    return [f for f in catalogue() if family in (None, f.family) and all(w in f"{f.id} {f.name} {f.expression} {f.description}".lower() for w in words)]


def find(key: str) -> Factor:
    """A factor by id, or by name if only one family has it."""
    hits = [f for f in catalogue() if key.lower() == f.id] or [f for f in catalogue() if key.upper() == f.name]
    if len(hits) != 1:
        raise KeyError(f"{key}: {'unknown factor' if not hits else 'several factors have this name, use an id'}")
    return hits[0]
