"""Plans made of several operators: ordered scans, segmentation, feature scores, listings."""
