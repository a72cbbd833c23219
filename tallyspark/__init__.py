"""tallyspark: income/expense ledger analytics as Spark DataFrame operators.

Every operator takes a ledger DataFrame with the columns

    tx_id string, user_id long, t_type string, category string,
    amount decimal(18,2), tx_date date, note string

and a ``by`` list of key columns (default ``["user_id"]``; an empty list
means the whole ledger is one key), so every user is computed in one job.
Time-relative operators take an explicit ``as_of`` date instead of the clock.
"""

from tallyspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
