"""veilgauge: cryptographic posture analytics for encrypted links, on Spark."""
