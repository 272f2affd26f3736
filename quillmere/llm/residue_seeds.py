"""Training material for the residue models, put together by rule from public standards and common usage.

No line comes from any table: status phrases are those of HTTP, system messages those of the C library and of Python, the Latin
filler is the passage of Cicero that printers use, and notices, letters and placeholders are composed from short word
lists.  The lists are examples to fit character statistics on, not patterns to look for; a model fitted on them has to find
residue of other wording too (``tests/llm/test_residue.py`` leaves out whole kinds of message).
"""

from __future__ import annotations

import builtins
import errno
import os
import random
from http import HTTPStatus

#: Names of fields, and the ways in which template languages, mail merges and word processors write a field.
FIELDS = (
    "收件人 收货人 甲方 乙方 公司名 公司名称 您的姓名 联系人 联系电话 手机号 邮箱 起始日期 截止日期 生效日期 年份 产品名称 项目名称 合同金额 数量 单价 编号 订单号 部门 职位 职务 城市 签名 审批人 备注 主题 正文 原因 "
    "first_name last_name full_name firstName userName company company_name email phone address city country start_date end_date deadline price total quantity product_name project manager signature subject body reason link url sender recipient department position account_number invoice_id"
).split()
STYLES = "{{~}} {{|~|}} {{{~}}} {~} ${~} $!{~} #{~} <~> <<~>> «~» [~] [[~]] 【~】 ［~］ 〔~〕 {%|~|%} <%=|~|%> <?=|~|?> %%~%% %~% %(~)s __~__ ##~## @@~@@ *|~|* [your|~|here] [insert|~|here] [此处填写~] [请输入~]".split()
#: Requests to fill in something, in brackets that text often has too.
ASKED = "（请填写~） （填写~） （此处写~） (enter|~) (insert|~|here)".split()
BARE = "%s %d {0} {1} $1 ___ ______ ＿＿＿＿ ××× XX xx XXXX xxxx XX年XX月XX日 ____年__月__日 TBD TBC TODO N/A undefined null NaN None [object|Object] DD/MM/YYYY YYYY-MM-DD 待定 待填 待补".split()

#: Forms of letters, notices and agreements; @ is a field.
LETTERS = (
    "@先生/女士，您好！感谢您选购@，货款@已收到。",
    "亲爱的@：您的账户@将在@停用。",
    "尊敬的@，您预订的@已确认，时间为@，地点为@。",
    "兹证明@系我单位员工，任@一职，入职日期为@。",
    "本合同由@（甲方）和@（乙方）于@在@订立。",
    "甲方应于@前向乙方支付@元整。",
    "@同志：请你于@到@报到。",
    "关于@申请@的批复，同意自@起执行。",
    "@您好，您的快递@已由@签收。",
    "订单@的发票已开具，抬头为@，金额为@。",
    "会议主题：@；会议时间：@；主持人：@。",
    "本月@的负责人为@，如有疑问请致电@。",
    "此致 @ 敬上 @",
    "提醒：@的账单@将于@逾期，请@处理。",
    "@申请的@已交@审批，结果将在@前告知。",
    "Hello @, your order @ for @ has been confirmed and will arrive on @.",
    "Dear @, we are pleased to offer you the position of @ at @, starting @.",
    "Hi @, thanks for signing up to @! Your account number is @.",
    "This contract is made on @ by and between @ and @.",
    "Invoice @ for @ is due on @. Please pay @.",
    "To whom it may concern: @ has worked for @ since @.",
    "Your appointment with @ is set for @ at @.",
    "@ has invited you to @. Reply to @ before @.",
    "Sincerely, @, @",
    "Meeting with @ on @ about @; notes are taken by @.",
    "Your request @ was passed to @, who will answer by @.",
    "This is a reminder that @ must return @ to @ by @.",
)
FILLED = ("李明", "王芳", "张伟", "陈先生", "财务部", "人事处", "华东分公司", "会议室三", "经理", "总监", "一千元", "三百件", "打印机", "笔记本电脑", "KD-20391847", "SN88213", "HT2025-031", "Alice Brown", "Mr. Smith", "Acme Ltd", "Berlin", "the sales team", "a laptop", "USD 1,200", "+1 555 0100", "info@example.com")
MONTHS = "January February March April May June July August September October November December".split()

#: The printers' passage, from Cicero's De finibus.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum "
    "sed ut perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta explicabo nemo enim ipsam"
).split()
ENDINGS = "us um is it et or em ae a i o ent ant unt ibus orum arum ere are ire ius ium men tas tio tur".split()
#: What placeholder text is made of: what it stands for, and words that say so.
ZH_KIND = "文字 文本 内容 标题 正文 段落 图片 说明 描述 摘要 栏目 页面 副标题 标签 名称".split()
ZH_STAND = "这里是@ 此处为@ 示例@ 占位@ 测试@ 填充@ @占位符 @示例 样例@ 请输入@ 在此输入@ 请在此处添加@ @@@ @一@二@三 假@ @待填写 @待补充 此处插入@ 粘贴@到这里".split()
ZH_MASH = "啊 哈 嗯 呃 一二三四 某某 测试 哈哈 ＊ × ○ □ … 甲乙丙丁 阿巴".split()
EN_KIND = "text content title heading paragraph image caption description summary body section label name copy page".split()
EN_STANDS = ("@ goes here", "your @ here", "sample @", "example @", "placeholder @", "placeholder for @", "dummy @", "test @", "filler @", "insert @ here", "add your @ here", "type @ here", "replace this @", "replace with @", "enter @ here", "@ one @ two @ three", "this is a @", "some @ here", "@ to be added", "@ to come")
EN_MASH = "blah foo bar baz qux test asdf qwerty xxx abc aaa hello yada zxcv jkl 123".split()

#: Error pages and messages in Chinese: what fails, how, and what to do.
ZH_WHAT = "页面 网页 网站 链接 文件 文档 资源 内容 图片 服务器 服务 系统 接口 数据 数据库 网络 网关 连接 请求 响应 会话 登录 账号 账户 验证码 密码 权限 订单 接口调用 上传 下载 支付 操作 进程 端口 磁盘 内存 证书 域名 代理 缓存 主机 程序 应用 队列".split()
ZH_FAULT = "不存在 未找到 找不到 已被删除 已移除 已下架 已失效 已过期 已关闭 无法访问 无法打开 无法显示 无法连接 无法加载 加载失败 打开失败 读取失败 写入失败 解析失败 提交失败 校验失败 出错 出现错误 发生异常 异常 错误 崩溃 中断 已断开 被重置 被拒绝 被拦截 超时 响应超时 繁忙 过载 不可用 暂时不可用 暂停服务 正在维护 维护升级中 正在升级 不足 已满 已用尽 受限 被禁止 已锁定 已冻结 未授权 未登录 没有权限 无响应 未启动 被占用 过多 过于频繁 达到上限".split()
ZH_TODO = "请稍后再试 请稍候重试 请刷新页面 请刷新后重试 请重试 请检查网络连接 请检查网址是否正确 请检查代理设置 请重新登录 请联系管理员 请联系客服 请联系技术支持 请返回首页 返回上一页 返回首页 点击刷新 点此重试 重新加载 关闭此窗口 请更换浏览器 请与网站管理员联系 请等待 请排队 请查看日志 详情见日志 请降低访问频率 请输入正确的地址 请申请权限 请清除缓存后再试".split()
ZH_LEAD = "抱歉， 对不起， 很抱歉， 非常抱歉， 哎呀， 糟糕， 出错了！ 提示： 系统提示： 错误： 错误信息： 错误提示： 警告： 温馨提示： 您访问的 您查找的 您要访问的 您请求的 当前 该 此 本 由于".split()
ZH_CODE = "错误码：@|错误代码 @|错误 @|状态码 @|请求编号：@|请求 ID：@|追踪号 @|事件编号 @|日志编号：@|服务器返回 @|HTTP @|代码：@|时间：0|发生时间 0|0 秒后自动跳转|0 秒后重试|预计 0 恢复|耗时 0 毫秒|等待 0 秒无应答|第 0 行出错".split("|")

#: The same in English.
EN_WHAT = "the page|this page|the site|the link|the file|the document|the resource|the content|the server|the service|the system|the application|the request|the connection|the network|the gateway|the database|your session|your account|your login|the upload|the download|the operation|the process|the port|the disk|the host|the certificate|the queue|the upstream server|the response|access|the website|the script|the job".split("|")
EN_FAULT = "could not be found|was not found|does not exist|no longer exists|has been removed|has been moved|has been deleted|has expired|is unavailable|is temporarily unavailable|is not available|is down|is down for maintenance|is under maintenance|is overloaded|is busy|timed out|did not respond|is not responding|was reset|was refused|was closed|was lost|failed|failed to load|could not be loaded|cannot be displayed|cannot be opened|could not be parsed|could not be reached|has encountered an error|encountered an unexpected error|has crashed|is not running|is in use|is full|is denied|is forbidden|is restricted|is not allowed|is locked|has been suspended|is invalid|was aborted|has been blocked|exceeded the limit".split("|")
EN_TODO = "please try again|please try again later|try again in a few minutes|please refresh the page|reload the page|please check your connection|check the address and try again|please sign in again|please log in|please contact support|contact the administrator|contact the site owner|go back|go to the home page|return to homepage|return to the previous page|click here to retry|please wait|see the log for details|clear your cache and cookies|report this problem|check your proxy and firewall|you do not have permission to view it|you are not authorized|slow down".split("|")
EN_LEAD = "sorry, |we're sorry, |oops! |whoops, |uh oh! |error: |fatal: |warning: |something went wrong: |an error occurred: |it looks like |unfortunately |we are sorry but ".split("|")
EN_CODE = "error code: @|error @|status: @|status code @|request id: @|reference: @|trace id @|incident @|ray id: @|correlation id: @|http @|code @|time: 0|timestamp: 0|elapsed 0 ms|after 0 seconds|retry after 0|line 0, column 0|errno 0|exit code 0|port 0".split("|")
NAVIGATE = "首页 | 返回 | 重试 | 刷新 | 帮助 | 联系我们 | 上一页 | 下一页 | 登录 | 注册 | home | back | retry | help | contact us | login | refresh | previous | next | sign in | search".split(" | ")
#: How programs report where they failed; < > are names.
TRACES = (
    'File "<a>.py", line 0, in <b>', "  <b>(<a>)", "    return <a>.<b>()", "Traceback (most recent call last):", "During handling of the above exception, another exception occurred:", "at <a>.<b>(<a>.java:0)", "at com.<a>.<b>.<a>(<b>.java:0)",
    "Caused by: java.lang.<E>: <a> <b>", 'Exception in thread "main" java.lang.<E>', "at <b> (/app/<a>.js:0:0)", "at Object.<b> (<a>.ts:0:0)", "at <a>.<b>() in <a>.cs:line 0", "#0 <b>()", "#1 <a>-><b>()", "{main} thrown in <a>.php on line 0",
    "PHP Fatal error: Uncaught <E>: <a> in <b>.php:0", "Warning: <a>() expects parameter 0", "panic: runtime error: <a>", "goroutine 0 [running]:", "<a>.go:0 +0x0", "<E>: <a> is not defined", "<E>: cannot read properties of undefined (reading '<a>')",
    "ORA-0: <a> <b>", "SQLSTATE[0]: <a>", "ERROR 0 (0): <a> denied for user '<b>'", "segmentation fault (core dumped)", "stack trace:", "call stack:", "nginx/0.0", "Apache/0.0 Server at <a> Port 0", "<E>: <b> failed", "<a>: <b> at 0x0",
)
NAMES = "main app index server handler client worker session request response view render parse load fetch open read write connect query model user page core util config router service loop init start run exec process cache store file stream".split()
JAVA = "NullPointerException IllegalStateException IllegalArgumentException ClassCastException OutOfMemoryError StackOverflowError IOException SocketTimeoutException TypeError ReferenceError RangeError SyntaxError".split()

#: Notices that scripts are needed: what must be done, and to what end; @ is the name of scripts.
SCRIPT = "JavaScript|Javascript|JS|js|scripts|scripting|JavaScript and cookies|client-side scripts".split("|")
EN_NEED = "please enable @|you need to enable @|you must enable @|@ is required|@ must be enabled|this page requires @|this site requires @|this app needs @|this application works only with @|@ is disabled in your browser|@ is turned off|your browser does not support @|your browser has @ disabled|it seems that @ is disabled|turn on @|allow @ in your browser settings|we have detected that @ is disabled|enable @|sorry, we need @|for full functionality of this site it is necessary to enable @".split("|")
EN_END = "to continue|to view this page|to run this app|to use this site|to see the content|and reload the page|and refresh|in order to proceed|for the best experience|or switch to a supported browser|in your browser settings|to load this page|before you continue|and try again|or use another browser|or disable your ad blocker|while we verify your browser|the content cannot be shown without it".split("|")
ZH_SCRIPT = "JavaScript|JS|js|脚本|Javascript|JavaScript 脚本|JavaScript 和 Cookie|浏览器脚本".split("|")
ZH_NEED = "请启用 @|请开启 @|请打开 @|请允许运行 @|您需要启用 @|需要启用 @|必须开启 @|本页面需要 @ 支持|本站需要 @|此应用依赖 @|您的浏览器不支持 @|您的浏览器已禁用 @|您的浏览器未开启 @|检测到 @ 被禁用|检测到您关闭了 @|@ 未启用|@ 已被禁用|没有 @ 无法显示|不支持 @ 的浏览器无法使用".split("|")
ZH_END = "以继续访问|才能正常浏览|后刷新页面|后重试|以查看内容|以获得完整功能|否则页面无法显示|然后重新加载|或更换浏览器|请在浏览器设置中打开|再继续|内容将在脚本加载后显示|请使用新版浏览器|否则无法使用本站|请关闭拦截插件".split("|")
BROWSER = "checking your browser|please wait while we check your browser|your browser is out of date|this browser is not supported|please upgrade your browser|loading|正在加载|正在检查您的浏览器|浏览器版本过低|请升级浏览器|请使用 Chrome 浏览器|页面正在加载，请稍候|please turn off your ad blocker|cookies are required|请启用 Cookie|noscript|verify you are human|正在验证您的浏览器".split("|")

#: The kinds of message that can be left out to see what the others are worth.
MESSAGES = ("status", "system", "zh_error", "en_error", "trace", "en_script", "zh_script", "browser")


def _statuses() -> list[str]:
    """Status codes, phrases and descriptions of HTTP from 400 on."""
    out = []
    for s in HTTPStatus:
        if s >= 400:
            out += [f"{int(s)} {s.phrase}", s.phrase, f"HTTP {int(s)}", f"{int(s)} - {s.phrase}", f"HTTP Error {int(s)}. {s.phrase}", f"错误 {int(s)}", *([s.description] if s.description else [])]
    return out


def _systems() -> list[str]:
    """Messages of the C library, and names of Python's errors with some of them."""
    said = [os.strerror(n) for n in errno.errorcode]
    errors = [n for n in dir(builtins) if n.endswith("Error")]
    return said + [f"{e}: {s}" for e, s in zip(errors * 2, said, strict=False)] + [f"{a}: {b}" for a, b in zip(errno.errorcode.values(), said, strict=True)]


def material(seed: int = 7, without: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Lines of each kind, put together by rule and always the same, without some kinds of message."""
    rng = random.Random(seed)
    pick = rng.choice

    def field(asked: bool) -> str:
        if rng.random() < 0.25:
            return pick(BARE).replace("|", " ")
        name = pick(FIELDS)
        if rng.random() < 0.15:
            name = name.upper()
        return pick(ASKED if asked and rng.random() < 0.1 else STYLES).replace("|", " ").replace("~", name)

    def filled() -> str:
        """A value in a field: as often a date in one of four forms as anything else."""
        if rng.random() < 0.5:
            return pick(FILLED)
        y, m, d = rng.randint(2020, 2029), rng.randint(1, 12), rng.randint(1, 28)
        return pick((f"{y}-{m:02d}-{d:02d}", f"{y} 年 {m} 月 {d} 日", f"{m} 月 {d} 日", f"{d} {MONTHS[m - 1]} {y}", f"{y}年{m}月{d}日", f"{MONTHS[m - 1]} {d}, {y}"))

    def letter(unfilled: float, asked: bool = True) -> str:
        parts = pick(LETTERS).split("@")
        fill = [field(asked) if rng.random() < unfilled else filled() for _ in parts[1:]]
        return parts[0] + "".join(f + p for f, p in zip(fill, parts[1:], strict=True))

    fields = [letter(0.7) for _ in range(8000)]
    signs = [letter(0.7, False) for _ in range(8000)]
    letters_filled = [letter(0.0) for _ in range(8000)]

    def word() -> str:
        """A word of the passage, or its beginning with another Latin ending."""
        w = pick(LATIN)
        return w if rng.random() < 0.5 or len(w) < 4 else w[: rng.randint(2, len(w) - 1)] + pick(ENDINGS)

    def zh_filler() -> str:
        one = pick(ZH_STAND).replace("@", pick(ZH_KIND)) if rng.random() < 0.8 else pick(ZH_MASH) * rng.randint(2, 5)
        return one * rng.randint(1, 3) + pick(("", "。", "，", "、", "！", "……"))

    def en_filler() -> str:
        if rng.random() < 0.25:
            return " ".join([pick(EN_MASH)] * rng.randint(2, 5)) if rng.random() < 0.5 else " ".join(pick(EN_MASH) for _ in range(4))
        one = pick(EN_STANDS).replace("@", pick(EN_KIND))
        return one[0].upper() + one[1:] + pick(("", ".", "...", "!"))

    filler = []
    for _ in range(1500):
        filler.append("".join(zh_filler() for _ in range(rng.randint(1, 4))))
        filler.append(" ".join(en_filler() for _ in range(rng.randint(1, 3))))
        filler.append(" ".join(word() for _ in range(12)) + ".")
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(pick(letters) for _ in range(rng.randint(3, 9))) for _ in range(10)) for _ in range(1500)]

    def token() -> str:
        return pick((f"{rng.randint(0, 16**10):010x}", f"{rng.randint(0, 16**8):08x}", f"{pick('ABEHRTX')}{rng.randint(100, 99999)}", str(rng.randint(100, 9999)), f"{rng.randint(0, 16**4):04x}-{rng.randint(0, 16**4):04x}"))

    def coded(forms: list[str]) -> str:
        return pick(forms).replace("@", token()).replace("0", str(rng.randint(1, 900)))

    def zh_error() -> str:
        said = (pick(ZH_LEAD) if rng.random() < 0.4 else "") + pick(ZH_WHAT) + pick(("", "", "", "已", "暂", "可能")) + pick(ZH_FAULT)
        if rng.random() < 0.15:
            said += pick(("或", "，", "，可能")) + pick(ZH_FAULT)
        tail = pick(("", "，" + pick(ZH_TODO), "。" + pick(ZH_TODO), " " + coded(ZH_CODE), "（" + coded(ZH_CODE) + "）", "！", "。"))
        return said + tail

    def en_error() -> str:
        said = (pick(EN_LEAD) if rng.random() < 0.4 else "") + pick(EN_WHAT) + " " + pick(EN_FAULT)
        if rng.random() < 0.15:
            said += pick((" or ", ", ", " and ")) + pick(EN_FAULT)
        tail = pick(("", ", " + pick(EN_TODO), ". " + pick(EN_TODO), " (" + coded(EN_CODE) + ")", ": " + coded(EN_CODE), "!", "."))
        return said + tail

    def trace() -> str:
        errors = [*JAVA, *(n for n in dir(builtins) if n.endswith("Error"))]
        return pick(TRACES).replace("<a>", pick(NAMES)).replace("<b>", pick(NAMES)).replace("<E>", pick(errors)).replace("0x0", f"0x{rng.randint(0, 16**8):08x}")

    statuses, systems = _statuses(), _systems()
    make = {
        "status": lambda: pick(statuses),
        "system": lambda: pick(systems),
        "zh_error": lambda: pick((zh_error, zh_error, zh_error, lambda: pick(ZH_TODO), lambda: coded(ZH_CODE), lambda: " ".join(pick(NAVIGATE) for _ in range(3))))(),
        "en_error": lambda: pick((en_error, en_error, en_error, lambda: pick(EN_TODO), lambda: coded(EN_CODE)))(),
        "trace": trace,
        "en_script": lambda: pick(EN_NEED).replace("@", pick(SCRIPT)) + pick((" " + pick(EN_END), ", " + pick(EN_END), ". " + pick(EN_TODO), "", ".")),
        "zh_script": lambda: pick(ZH_NEED).replace("@", pick(ZH_SCRIPT)) + pick((pick(ZH_END), "，" + pick(ZH_END), "。", "")),
        "browser": lambda: pick(BROWSER),
    }
    share = {"status": 600, "system": 500, "zh_error": 3000, "en_error": 2500, "trace": 900, "en_script": 900, "zh_script": 900, "browser": 400}
    notices = [make[kind]() for kind in MESSAGES if kind not in without for _ in range(share[kind])] or [""]
    return {"field": fields, "signs": signs, "filled": letters_filled, "filler": filler, "noise": noise, "notice": notices}
