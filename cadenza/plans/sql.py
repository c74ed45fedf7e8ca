"""Shared pieces of the SQL that the queries are checked against."""

FRAMES = """frames AS (SELECT vec_id AS k, label, TIMESTAMP '2025-06-20 00:00:00' + to_minutes(30 * vec_id::INT) AS time,
  list_transform(embedding, lambda e: 250.0::DOUBLE + 60.0::DOUBLE * e::DOUBLE) AS bt FROM embeddings)"""
MASKED_FRAMES = FRAMES + """, masked AS (SELECT k, label, list_transform(bt, lambda e, n: CASE WHEN least((n - 1) // 8, 7 - (n - 1) // 8) + least((n - 1) % 8, 7 - (n - 1) % 8) < 2 THEN NULL ELSE e END) AS bt FROM frames)"""
CELLS = "unnest(range(0, 64)) AS cells(i)"
PX = """px AS (SELECT vec_id AS k, label, (i // 8)::INT AS y, (i % 8)::INT AS x, i, 250.0::DOUBLE + 60.0::DOUBLE * embedding[i + 1]::DOUBLE AS bt
  FROM embeddings, unnest(range(0, 64)) AS r(i))"""
MASKED = PX.replace("px AS (SELECT", "full_px AS (SELECT") + """, px AS (SELECT k, label, y, x, i,
  CASE WHEN least(y, 7 - y) + least(x, 7 - x) < 2 THEN NULL ELSE bt END AS bt FROM full_px)"""
MIDDLE = """middle AS (SELECT m.k, m.label, m.y, m.x, m.i, m.bt AS truth, a.bt AS a, b.bt AS b, 0.5::DOUBLE * a.bt + 0.5::DOUBLE * b.bt AS pred
  FROM px m JOIN px a ON a.k = m.k - 1 AND a.i = m.i JOIN px b ON b.k = m.k + 1 AND b.i = m.i)"""
SERIES = "series AS (SELECT user_id, event_id, ts, 180.0::DOUBLE + 140.0::DOUBLE * least(value, 350.0::DOUBLE) / 350.0::DOUBLE AS bt, event_type FROM events)"


def unit(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - 180.0::DOUBLE) / 140.0::DOUBLE)) END)"


def rmse(pred: str, truth: str) -> str:
    return f"sqrt(avg(({pred} - {truth}) * ({pred} - {truth})))"


def pixel_metrics(pred: str = "pred", truth: str = "truth") -> str:
    u = f"({unit(pred)} - {unit(truth)})"
    ok = f"CASE WHEN {pred} IS NOT NULL AND {truth} IS NOT NULL THEN"
    return f"""round(avg({pred} - {truth}), 6) AS bt_bias_k, round({rmse(pred, truth)}, 6) AS bt_rmse_k, round(avg({ok} {u} * {u} END), 8) AS mse,
  round(avg({ok} abs({u}) END), 6) AS mae, round(sqrt(avg({ok} {u} * {u} END)), 6) AS rmse, round(-10.0::DOUBLE * log10(avg({ok} {u} * {u} END)), 6) AS psnr, count({ok} 1 END) AS n_valid"""


def sensor(name: str) -> str:
    """Pixels px_<name> of another sensor, given px."""
    from cadenza.sources.views import SENSORS

    gain, offset, p, q, m, _ = SENSORS[name]
    return f"px_{name} AS (SELECT k, label, y, x, i, {gain}::DOUBLE * bt + {offset}::DOUBLE + (((k * {p} + i * {q}) % {m}) - {m // 2}) / 10.0::DOUBLE AS bt FROM px)"


def as_px(name: str) -> str:
    """Pixels of another sensor under the name px."""
    return PX.replace("px AS (", "base AS (", 1) + ", " + sensor(name).replace(f"px_{name} AS", "px AS", 1).replace("FROM px)", "FROM base)")


def mirrored(values: str, dy: str | int, dx: str | int) -> str:
    """The value of a list at an offset of cell i, mirrored at the border."""
    return f"{values}[(7 - abs(7 - abs(i // 8 + {dy}))) * 8 + 7 - abs(7 - abs(i % 8 + {dx})) + 1]"


#: Predicted and true frames as lists p and g on the unit interval.
UNIT_FRAMES = FRAMES + f""", unit_frames AS (SELECT m.k, list_transform(m.bt, lambda e: {unit('e')}) AS g,
  list_transform(range(1, 65), lambda n: {unit('(0.5::DOUBLE * a.bt[n] + 0.5::DOUBLE * b.bt[n])')}) AS p FROM frames m JOIN frames a ON a.k = m.k - 1 JOIN frames b ON b.k = m.k + 1)"""
