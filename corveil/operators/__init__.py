"""DataFrame operators: group statistics, losses, metrics, batching, balancing, rewards and formatting."""
