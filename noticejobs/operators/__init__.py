"""Jobs: functions from DataFrames to DataFrames. Clocks are explicit ``as_of`` arguments."""
