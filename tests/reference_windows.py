"""Row-by-row window features in plain pandas, for small frames."""

from __future__ import annotations

import numpy as np
import pandas as pd


def brute_force(ticks: pd.DataFrame, w: int, min_ticks: int = 5) -> pd.DataFrame:
    out = []
    for _, g in ticks.groupby("symbol"):
        g = g.sort_values(["time", "tick_id"]).reset_index(drop=True)
        g["direction"] = np.sign(g["last"].diff()).fillna(0).astype(int)
        g["ret"] = g["last"].pct_change()
        g["mid"], g["spread"] = (g.bid + g.ask) / 2, g.ask - g.bid
        g["sec"] = g["time"].astype("datetime64[us]").astype("int64") / 1e6
        velocity_before = None
        for i in range(len(g)):
            r = g.iloc[: i + 1]
            r = r[r["time"] > g["time"][i] - pd.Timedelta(seconds=w)]
            n, p, v, d = len(r), r["last"], r.volume, r.direction
            f = {"tick_id": g.tick_id[i], "volatility": r.ret.std() if r.ret.notna().sum() > 1 else None}
            if n >= min_ticks:
                total = v.sum() or 1
                buy, sell = v[d == 1].sum(), v[d == -1].sum()
                up, down, reach = (d > 0).sum(), (d < 0).sum(), p.max() - p.min()
                last50 = g.volume[max(0, i - 49): i + 1]
                f |= {
                    "tick_velocity": n / w, "price_velocity": (p.iloc[-1] - p.iloc[0]) / w,
                    "range_velocity": reach / w, "momentum": d.sum(),
                    "trend_consistency": max(up, down) / (up + down) if up + down else 0,
                    "rejection_strength": 1 - abs(p.iloc[-1] - p.iloc[0]) / reach if reach else 0,
                    "level_tests": max((p >= p.max() * 0.9999).sum(), (p <= p.min() * 1.0001).sum()),
                    "directional_persistence": 1 - (d.diff() != 0).sum() / n,
                    "buy_pressure": buy / total, "sell_pressure": sell / total, "volume_imbalance": (buy - sell) / total,
                    "volume_spike": v.sum() / last50.mean() if len(last50) >= 10 and last50.mean() else None,
                    "large_print_ratio": (v > v.mean() * 3).sum() / n, "volume_velocity": v.sum() / w,
                    "spread_normalized": r.spread.mean() / (r.mid.mean() or 1), "spread_volatility": r.spread.std(),
                    "bid_change_freq": (r.bid.diff() != 0).sum() / w, "ask_change_freq": (r.ask.diff() != 0).sum() / w,
                    "avg_time_between_ticks": r.sec.diff().dropna().mean(),
                    "tick_size_adherence": (p.diff().dropna() % 0.5 == 0).sum() / (n - 1),
                }
            velocity = f.get("price_velocity")
            f["acceleration"] = None if velocity is None or velocity_before is None else velocity - velocity_before
            velocity_before = velocity
            out.append(f)
    return pd.DataFrame(out).set_index("tick_id").sort_index()
