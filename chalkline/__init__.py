"""chalkline: marketplace analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus an explicit ``as_of`` where time
matters) and returns lazy DataFrames. Nothing collects to the driver.
"""

__version__ = "0.1.0"
