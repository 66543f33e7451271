"""chronotext: time-coded text analytics as Spark DataFrame transformations."""
