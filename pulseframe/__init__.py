"""pulseframe: Spark-native analytics for event trains, their waveforms and the tables around them."""
