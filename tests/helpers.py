import math


def norm(v, sig=6):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.{sig}g}")
    if hasattr(v, "item"):
        return norm(v.item(), sig)
    return v


def canon(rows, cols, sig=6):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], sig) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def rows_of(df):
    return [tuple(r) for r in df.collect()], df.columns
