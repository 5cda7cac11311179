"""The test tables seen as flyer data, and the SQL the results are checked with."""
