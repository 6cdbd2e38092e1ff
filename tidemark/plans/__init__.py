"""Jobs that chain operators: training, promotion, scoring, monitoring, lifecycle."""
