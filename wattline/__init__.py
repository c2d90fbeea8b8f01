"""wattline: hourly electricity-grid demand analytics on Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame (or a Column expression).
Nothing here runs a Spark action unless its name says so (``write_*``, ``run_*``).

Conventions used throughout:

* the session time zone is UTC, ``period`` is the UTC hour, ``ba_code`` the balancing authority;
* ``period`` and ``ba_code`` are key columns and never NULL;
* ANSI mode is assumed on, so divisions go through ``nullif`` and casts through ``try_cast``.
"""
