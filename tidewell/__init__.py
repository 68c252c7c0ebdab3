"""tidewell: event-stream and keyed-table analytics, declared on Spark DataFrames."""
