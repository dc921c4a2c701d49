"""Panel Atlas: territorial panel analytics on Spark."""
