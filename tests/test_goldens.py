"""Goldens from FIXTURES.md §3: monthly totals of the reference's datasets -> trend and forecast.

Each month is rebuilt as one income and one expense row with the month totals given there;
trend (E2) and next-month forecast (H1) only depend on those totals.
"""

import pytest

from conftest import collect
from tallyspark.operators import ordered as E
from tallyspark.operators import rollups as C

# (month, income, expense) per dataset, and the expected trend and forecast (FIXTURES.md §3)
GOLDENS = {
    "finance_dataset": ([("2024-01", 3500, 850), ("2024-02", 3100, 1200), ("2024-03", 3800, 1295),
                         ("2024-04", 3900, 1360)], "up", 5632.5),
    "finance_test": ([("2024-05", 3950, 1375), ("2024-06", 3900, 1435)], "up", 5345.0),
    "synthetic": ([("2025-04", 0, 125.12), ("2025-05", 7032.89, 840.37), ("2025-06", 8620.94, 833.16),
                   ("2025-07", 12210.16, 810.23), ("2025-08", 13633.32, 933.76), ("2025-09", 7974.09, 413.57)],
                  "mixed", 15400.64667),
    "transactions_export": ([("2025-09", 2032000.00, 1129089.99), ("2025-10", 0, 67215.00)],
                            "down", -3026659.99),
}


@pytest.mark.parametrize("name", sorted(GOLDENS))
def test_trend_and_forecast_match_goldens(make_ledger, name):
    months, trend, forecast = GOLDENS[name]
    rows = []
    for m, inc, exp in months:
        if inc:
            rows.append((f"{m}-i", 1, "income", "Salary", inc, f"{m}-10"))
        rows.append((f"{m}-e", 1, "expense", "Rent", exp, f"{m}-20"))
    L = make_ledger(rows)
    io = collect(C.monthly_in_out(L, by=[]), ["month"])
    assert [(r["month"], float(r["income"]), float(r["expense"])) for r in io] == \
        [(m, float(i), float(e)) for m, i, e in months]
    t = collect(E.trend(L, by=[]))[0]
    assert t["trend"] == trend
    f = collect(E.forecast_next(L, by=[]))[0]
    assert abs(f["forecast_next_month"] - forecast) < 1e-4
