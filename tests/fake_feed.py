"""A chat feed in a JSON file, for tests: {"chats": {chat: [message numbers]}, "slow": {chat: largest page that is in time}, "broken": [chats]}."""

import json
import os


class Client:
    def __init__(self, options):
        self.path = options["path"]

    def _state(self):
        with open(self.path) as f:
            return json.load(f)

    def _asked(self, line):
        with open(self.path + ".asked", "a") as f:
            f.write(line + "\n")

    def chats(self):
        return [int(c) for c in self._state()["chats"]]

    def _message(self, chat, n):
        return {"id": n, "content_type": "text", "text": f"message {n} of {chat}", "sender_name": "Ann", "sender_id": 1, "is_bot": False, "reply_to": 0, "date": 1704067200 + n}

    def history(self, chat, before, limit):
        state = self._state()
        self._asked(f"{chat} {before} {limit}")
        if chat in state.get("broken", []):
            raise ValueError("chat is gone")
        if limit > state.get("slow", {}).get(str(chat), 1000):
            raise TimeoutError("timed out")
        return [self._message(chat, n) for n in sorted(state["chats"][str(chat)], reverse=True) if not before or n < before][:limit]

    def latest(self, chat):
        state = self._state()
        if chat in state.get("mute", []):
            raise ValueError("chat is gone")
        numbers = state["chats"][str(chat)]
        return self._message(chat, max(numbers)) if numbers else None


def client(options):
    return Client(options)


def write(path, **state):
    with open(path + ".new", "w") as f:
        json.dump(state, f)
    os.replace(path + ".new", path)


def asked(path):
    if not os.path.exists(path + ".asked"):
        return []
    with open(path + ".asked") as f:
        return f.read().split("\n")[:-1]
