"""barloom: daily-bar and company-filing analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) plus keyword arguments and returns a lazy
DataFrame (or Column).  Nothing collects to the driver.

Key bounds the operators rely on
--------------------------------
* ``bars`` has at most one row per (code, date).  The bars of one symbol are therefore bounded
  by the number of trading days (about 250 a year) whatever the size of the table; a hot
  symbol can hold many *ticks*, never many *bars*.  ``quality.duplicate_bars`` checks it.
* tables with one row per trading day (calendar, equity curve) are bounded by the calendar.
* ``filings`` has a handful of rows per (code, year, quarter).
"""

__version__ = "0.1.0"
