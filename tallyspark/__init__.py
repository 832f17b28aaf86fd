"""Financial analytics over tables of any size, written as Spark DataFrame plans."""
